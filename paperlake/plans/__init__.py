"""Plans over the token table: structure, graphs and documents."""

"""Sources: paper bundles in files, folders and archives."""

"""Sources: folders, stored objects, remote listings and file formats."""

"""Where entries come from: tables, file systems, archives, caches, disk images."""

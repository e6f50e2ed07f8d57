"""File discovery, image reading and snapshot tables."""

"""Part of lodestone."""

"""Version resolution, garbage collection, lookups and level arithmetic, as DataFrame functions."""

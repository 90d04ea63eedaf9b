"""Where versions come from and go to: storage, write-ahead segments, the manifest, logs of other tables."""

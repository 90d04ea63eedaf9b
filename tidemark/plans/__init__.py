"""Plans over the manifest: which files a read needs, and what a compaction takes."""

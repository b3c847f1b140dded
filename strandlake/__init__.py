"""Part of the strandlake package."""

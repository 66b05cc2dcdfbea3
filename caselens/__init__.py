"""caselens: case-evidence analytics, resolution and retrieval expressed as Spark plans."""

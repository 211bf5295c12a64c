"""The pipeline's stages over streams of messages."""

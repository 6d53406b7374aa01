"""Models behind interfaces, and what a chat does with them. Nothing here is distributed."""

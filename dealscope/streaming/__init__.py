"""streaming of the dealscope package."""

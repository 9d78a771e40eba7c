"""sources of the dealscope package."""

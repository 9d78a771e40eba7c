"""operators of the dealscope package."""

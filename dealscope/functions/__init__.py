"""functions of the dealscope package."""

"""Column functions: angles, poses, pixel differences, colours."""

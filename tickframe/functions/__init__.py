"""Column functions: angles, vectors, boxes, rates."""

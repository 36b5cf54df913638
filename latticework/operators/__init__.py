"""DataFrame operators on matrices, boxes, meshes and results."""

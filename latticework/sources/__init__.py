"""Tables to start from: points, grids, meshes, result documents and sample stores."""

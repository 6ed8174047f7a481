"""DataFrame operators on range images, clusters and objects."""

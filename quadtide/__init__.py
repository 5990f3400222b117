"""quadtide: declarative analytics over the past and present of timestamped RDF quads, on Spark."""

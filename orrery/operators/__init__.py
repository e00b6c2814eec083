"""Vector, neighbour, graph, layout and schema operators."""

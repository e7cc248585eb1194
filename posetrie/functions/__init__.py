"""Column expressions: poses, octants, boxes, rotations."""

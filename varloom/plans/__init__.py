"""Composed studies: the frames, boards and laws that several operators share."""

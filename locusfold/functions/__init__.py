"""Column functions of the library in one place."""

from ..operators.attribution import normalize_attr, relative_axis, relative_delta
from ..operators.importance import shuffle_region, unit_area
from ..operators.metrics import correlation, inverse_transform, target_transform
from ..operators.relational import category_order, dice, natural_chrom
from ..operators.sequence import (
    boundary_truncated, canonical_kmer, flank_in_bounds, kmers_of, motif_canonical, motif_class_from_window, perfect_repeat, reverse_complement, rotation_canonical, segment_labels, tile_motif,
)

__all__ = [
    "boundary_truncated", "canonical_kmer", "category_order", "correlation", "dice", "flank_in_bounds", "inverse_transform", "kmers_of", "motif_canonical", "motif_class_from_window",
    "natural_chrom", "normalize_attr", "perfect_repeat", "relative_axis", "relative_delta", "reverse_complement", "rotation_canonical", "segment_labels", "shuffle_region",
    "target_transform", "tile_motif", "unit_area",
]

"""Collective array operators as lazy DataFrame plans."""

from .control import acond, alet, atrace, awhile
from .elementwise import amap, transform, unzip, zip_with
from .foreign import foreign_acc, foreign_exp
from .indexing import (
    backpermute, drop, index, replicate, reshape, reverse, shift, slice_at, take, transpose,
)
from .reduce import fold, fold1, fold1_seg, fold_seg, segment_offsets
from .scan import scanl, scanl1, scanl_prime, scanr, scanr1, scanr_prime
from .scatter import compact, histogram, permute
from .stencil import Clamp, Constant, Function, Mirror, Wrap, stencil, stencil2

__all__ = [
    "acond", "alet", "atrace", "awhile", "amap", "transform", "unzip", "zip_with", "foreign_acc", "foreign_exp",
    "backpermute", "drop", "index", "replicate", "reshape", "reverse", "shift", "slice_at", "take", "transpose",
    "fold", "fold1", "fold1_seg", "fold_seg", "segment_offsets", "scanl", "scanl1", "scanl_prime", "scanr",
    "scanr1", "scanr_prime", "compact", "histogram", "permute", "Clamp", "Constant", "Function", "Mirror", "Wrap",
    "stencil", "stencil2",
]

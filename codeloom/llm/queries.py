"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .cross_parsing import op3_cross_parsing
from .flac import op8_flac
from .kdtree import OP4_SQL, op4_kdtree
from .license_scan import op5_license_scan
from .packing import op7_packing
from .secret_scan import op9_secret_scan
from .sentencepiece_codec import op1_sentencepiece
from .sharding import op10_sharding
from .simhash import op2_simhash
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_cross_parsing, op4_kdtree, op5_license_scan, op6_toxicity, op7_packing, op8_flac, op9_secret_scan, op10_sharding)}
ORACLE_SQL = {"op4_kdtree": OP4_SQL}

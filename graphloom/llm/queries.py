"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .imatch import op10_imatch
from .jaccardjoin import op8_jaccard_join
from .langid import op3_language_id
from .licenses import OP2_SQL, op2_licence_scan
from .linededup import OP9_SQL, op9_line_dedup
from .media import op7_media
from .mixing import OP6_SQL, op6_mixing
from .packing import op4_packing
from .quality import op1_quality
from .sharding import OP5_SQL, op5_sharding

QUERIES = {f.__name__: f for f in (op1_quality, op2_licence_scan, op3_language_id, op4_packing, op5_sharding, op6_mixing, op7_media, op8_jaccard_join, op9_line_dedup, op10_imatch)}
#: The other operators fit models, tokenize, decode images or join exactly by sets: they are tested against brute force.
ORACLES = {"op2_licence_scan": OP2_SQL, "op5_sharding": OP5_SQL, "op6_mixing": OP6_SQL, "op9_line_dedup": OP9_SQL}

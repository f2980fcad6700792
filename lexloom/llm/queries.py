"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .centroids import OP13_SQL, op13_centroids
from .decontaminate import OP9_SQL, op9_decontaminate
from .jaccard_join import op2_jaccard_join
from .kneser_ney import op10_kneser_ney
from .language_id import op4_language_id
from .mixing import op1_mixing
from .periodic_runs import op12_periodic_runs
from .preferences import OP8_SQL, op8_preferences
from .quality_knn import op5_quality_knn
from .quality_rules import op3_quality_rules
from .secret_crf import op6_secret_crf
from .wrappers import op7_wrappers

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_quality_knn": op5_quality_knn,
    "op6_secret_crf": op6_secret_crf,
    "op7_wrappers": op7_wrappers,
    "op8_preferences": op8_preferences,
    "op9_decontaminate": op9_decontaminate,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL = {"op8_preferences": OP8_SQL, "op9_decontaminate": OP9_SQL, "op13_centroids": OP13_SQL}

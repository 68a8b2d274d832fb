"""Queries of this folder and their SQL."""

from storyloom.llm import centroids, exact, lines
from storyloom.llm.alignment import op13_alignment
from storyloom.llm.bpe import op1_bpe
from storyloom.llm.centroids import op12_centroids
from storyloom.llm.exact import op8_exact_dedup
from storyloom.llm.language import op7_language_model
from storyloom.llm.lines import op2_line_dedup
from storyloom.llm.mixing import op4_mixing
from storyloom.llm.neighbours import op9_neighbours
from storyloom.llm.personal import op11_personal
from storyloom.llm.quality import op5_quality
from storyloom.llm.simhash import op10_simhash
from storyloom.llm.substring import op6_substring
from storyloom.llm.toxicity import op3_toxicity

OPERATORS = (
    op1_bpe,
    op2_line_dedup,
    op3_toxicity,
    op4_mixing,
    op5_quality,
    op6_substring,
    op7_language_model,
    op8_exact_dedup,
    op9_neighbours,
    op10_simhash,
    op11_personal,
    op12_centroids,
    op13_alignment,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op8_exact_dedup": exact.ORACLE,
    "op12_centroids": centroids.ORACLE,
}

"""Queries over the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

from lodestone.llm import collocations, decontaminate, divergence, license_scan, warc
from lodestone.llm.collocations import op13_collocations
from lodestone.llm.decontaminate import op2_decontamination
from lodestone.llm.divergence import op12_divergence
from lodestone.llm.embedding_dedup import op10_itq_dedup
from lodestone.llm.jaccard_join import op1_ngram_jaccard
from lodestone.llm.license_scan import op4_license_scan
from lodestone.llm.piece_bpe import op9_sentencepiece
from lodestone.llm.quality import op5_quality
from lodestone.llm.substring_dedup import op3_substring_dedup
from lodestone.llm.suffix_dedup import op6_suffix_array
from lodestone.llm.toxicity import op8_toxicity
from lodestone.llm.warc import op7_warc
from lodestone.llm.winnowing import op11_fingerprints

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_suffix_array": op6_suffix_array,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_itq_dedup": op10_itq_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_divergence": op12_divergence,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op7_warc": warc.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_collocations": collocations.ORACLE,
}

"""The registered queries of this subpackage and the SQL that some are held against."""

from __future__ import annotations

from linkscape.llm import chat, decontamination, hard_negatives, line_dedup, ngram_join, secrets
from linkscape.llm.alignment import op13_tokenizer_alignment
from linkscape.llm.bpe import op3_bpe
from linkscape.llm.chat import op4_chat_formatting
from linkscape.llm.decontamination import op9_benchmark_decontamination
from linkscape.llm.hard_negatives import op12_hard_negatives
from linkscape.llm.language import op10_language_id
from linkscape.llm.licenses import op5_license_scan
from linkscape.llm.line_dedup import op2_line_dedup
from linkscape.llm.media import op7_media_fingerprints
from linkscape.llm.ngram_join import op8_ngram_jaccard_join
from linkscape.llm.secrets import op6_secret_scan
from linkscape.llm.token_counts import op1_token_counts
from linkscape.llm.toxicity import op11_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_media_fingerprints": op7_media_fingerprints,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

#: Oracles in DuckDB SQL, over whole tables.
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_secret_scan": secrets.OP6_SQL,
    "op8_ngram_jaccard_join": ngram_join.OP8_SQL,
    "op9_benchmark_decontamination": decontamination.OP9_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}

"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import language_id, language_model, mixing, mpeg_audio, packing, retrieval, secrets, simhash, token_counts, toxicity

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_language_model": language_model.query,
    "op3_toxicity": toxicity.query,
    "op4_token_counts": token_counts.query,
    "op5_language_id": language_id.query,
    "op6_packing": packing.query,
    "op7_mpeg_audio": mpeg_audio.query,
    "op8_mixing": mixing.query,
    "op9_retrieval": retrieval.query,
    "op10_secrets": secrets.query,
}
ORACLES = {"op8_mixing": mixing.ORACLE}

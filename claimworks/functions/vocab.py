"""Vocabularies and ordered rules. Results depend on every one of them and on their order."""

VERDICTS = ["unreviewed", "supported", "weak", "contradicted", "retracted", "stale"]
EXCLUDED_VERDICTS = ["contradicted", "retracted", "stale"]
REVIEW_VERDICTS = ["weak", "unreviewed"]
SEVERITIES = ["critical", "high", "medium", "low"]
ACTION_STATES = ["open", "resolved", "ignored"]
STATUSES = ["candidate", "queued", "parsed", "chunked", "drafted", "qa_passed", "published", "stale", "failed", "archived"]
PLAN_STATES = ["published", "stale", "failed", "cached", "ready", "stageable", "blocked"]
CADENCE_DAYS = {"now": 0, "daily": 1, "weekly": 7, "monthly": 30}
INGEST_STATUSES = ["candidate", "queued", "failed"]
STALE_WORDS = ["latest", "current", "state of the art", "sota", "now"]
PROTOCOL_MARKERS = ["zero-shot", "few-shot", "pass@1", "pass@10", "base", "big", "eval", "benchmark"]
#: Family of a metric: the first rule of which a part is in the text decides; else "numeric".
FAMILY_RULES = [
    ("parameters", ["parameter", "activated", "active"]),
    ("tokens", ["token", "context"]),
    ("score", ["bleu", "accuracy", "pass@", "score", "mmlu", "aime", "gpqa", "humaneval", "%"]),
    ("languages", ["language"]),
    ("experts", ["expert"]),
]
MULTIPLIERS = {"": 1.0, "%": 1.0, "k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
SCALED_FAMILIES = ["parameters", "tokens", "numeric"]
KEY_STOP_WORDS = ["reported", "claim", "value", "metric", "model", "score", "result"]
PREDICATE_STOP_WORDS = ["reported", "claim", "value", "metric", "base", "big", "model"]
NO_BASELINE = ["as stated in source", "not applicable", "none"]
APPROXIMATE = ["", "about", "approx", "approx.", "approximately", "~"]
GENERIC_METRIC = "reported numeric claim"
QUOTE_LENGTH = 300
SYNTHESIS_ROWS = 24
SPREAD = 0.35
SOURCE_FIELDS = ["id", "title", "status", "created", "updated", "source", "tags"]
CONCEPT_FIELDS = ["id", "title", "created", "updated"]
LEDGER_FIELDS = ["claim_id", "source_id", "source_uuid", "claim_text", "evidence_quote", "evidence_hash", "anchor", "verdict", "created_at", "updated_at"]
#: Mojibake marks of wrongly decoded text.
SUSPICIOUS = "�ÃÂâ€™"
#: Titles that say nothing.
GENERIC_TITLES = ["abstract", "introduction", "references", "contents", "keywords"]
#: Tags of a text: a tag is given if one of its parts is in the text. Fixed values.
TAG_RULES = [
    ("deepseek", ["deepseek"]),
    ("attention", ["attention", "self-attention", "multi-head"]),
    ("transformer", ["transformer", "encoder", "decoder"]),
    ("language-model", ["language model", "language modeling", "translation", "sequence transduction"]),
    ("code", ["coder", "code", "programming", "humaneval"]),
    ("math", ["math", "aime", "mathematical"]),
    ("reasoning", ["reasoning", "r1", "grpo", "reinforcement"]),
    ("moe", ["moe", "mixture-of-experts", "expert"]),
    ("ocr", ["ocr", "document", "layout"]),
    ("multimodal", ["vl", "vision-language", "multimodal", "image"]),
    ("theorem-proving", ["prover", "lean", "theorem"]),
    ("vision-generation", ["janus", "flow", "generation", "visual"]),
    ("memory", ["engram", "memory"]),
    ("training-data", ["training data", "dataset", "data"]),
    ("evaluation", ["benchmark", "evaluation", "score"]),
]
#: Concepts of tags. Fixed values.
TAG_CONCEPTS = {
    "attention": "attention-mechanisms",
    "transformer": "transformer-architectures",
    "language-model": "language-modeling",
    "translation": "language-modeling",
    "evaluation": "evaluation-benchmarks",
    "deepseek": "deepseek-family",
    "code": "code-generation",
    "math": "mathematical-reasoning",
    "reasoning": "reinforcement-learning-reasoning",
    "moe": "mixture-of-experts",
    "ocr": "document-ocr",
    "multimodal": "multimodal-models",
    "theorem-proving": "theorem-proving",
    "vision-generation": "vision-generation",
    "memory": "memory-architectures",
    "training-data": "training-data",
}
#: Patterns of metric values in prose. Fixed values.
COMPACT_METRIC = r"(?<![A-Za-z])\d+(?:\.\d+)?\s*(?:B|M|K|T)\b"
EXPLICIT_METRIC = r"(?i)(?<![A-Za-z])\d+(?:\.\d+)?\s*(?:%|tokens?|parameters?|experts?|pages?|samples?|languages|benchmarks|gpu hours?)\b"
METRIC_CONTEXT = r"(?i)(parameter|activated|active|token|context|expert|language|benchmark|score|accuracy|training|cost|gpu|pass@|aime|math|mmlu|gpqa|humaneval|bleu|ocr|flop)"
CITATION_YEAR = r"(?i)\b(?:19|20)\d{2}[a-z]\b"
CITATION_MARKS = ["arxiv", "preprint", "et al", "proceedings"]
EVIDENCE_WORDS = r"(?i)(parameter|token|benchmark|score|accuracy|training|model|expert|AIME|MATH|HumanEval|GPQA|MMLU|OCR|BLEU|FLOP|%|B\b|M\b|K\b)"

"""Names and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that labels shorten, in this order.
SHORTER = (
    (r"(?i)^positive regulation of\s+", "+ "),
    (r"(?i)^negative regulation of\s+", "− "),
    (r"(?i)^regulation of\s+", "Reg. "),
    (r"(?i)\bsignaling pathway\b", "signaling"),
    (r"(?i)\bbiological process\b", "process"),
    (r"(?i)\bdifferentiation\b", "diff."),
    (r"(?i)\bproliferation\b", "prolif."),
    (r"(?i)\bmitochondrial\b", "mito."),
    (r"(?i)\btranscriptional regulation of\s+", "TF reg. "),
)
#: What an unmapped key's status says.
DROP_REASONS = {
    "ortholog_one2many": "No unique 1:1 ortholog (one-to-many). Dropped by one2one.",
    "ortholog_many2many": "Many-to-many ortholog. Dropped by one2one.",
    "no_ortholog": "No ortholog in the conversion table.",
    "dropped_ambiguous": "Ambiguous mapping; dropped by the active ortholog policy.",
}
NO_REASON = "Unmapped during ortholog conversion."
#: Metadata columns and words that speak for neural tissue.
NEURAL_COLUMNS = ("organ_major", "organ", "tissue_prior", "sample_organ", "tissue")
NEURAL = r"(?i)brain|neural|cns|cortex|hippocamp|spinal|cerebell"


def normal_id(key: Column) -> Column:
    """Trimmed; ids that begin with ENS lose their version."""
    key = F.trim(key)
    return F.when(F.startswith(key, F.lit("ENS")), F.substring_index(key, ".", 1)).otherwise(key)


def is_primary(key: Column) -> Column:
    """Whether an id is an ENS or FBgn one, not a symbol."""
    return F.startswith(key, F.lit("ENS")) | F.startswith(key, F.lit("FBgn"))


def capitalised(x: Column) -> Column:
    """First letter upper, the others lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))


def spellings(x: Column) -> Column:
    """A symbol's spellings in the order in which they are looked up: own, upper, lower, capitalised."""
    return F.array_distinct(F.array(x, F.upper(x), F.lower(x), capitalised(x)))


def short_label(term: Column, most: int = 34) -> Column:
    """Without a GO number, shortened by SHORTER, cut at a word's end with an ellipsis."""
    t = F.trim(F.regexp_replace(F.trim(term), r"\s*\(GO:\d+\)\s*$", ""))
    for pattern, by in SHORTER:
        t = F.regexp_replace(t, pattern, by)
    t = F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ,;"))
    cut = F.substring(t, 1, most - 1)
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(cut, F.lit(" ,;/-")), F.lit("…")))


def drop_reason(status: Column) -> Column:
    """A sentence for a status, with or without the prefix dropped_; unknown ones with spaces for underscores."""
    raw = F.trim(F.coalesce(status, F.lit("")))
    out = F.regexp_replace(raw, "_", " ")
    for key in (F.regexp_replace(raw, "^dropped_", ""), raw):
        for name, text in DROP_REASONS.items():
            out = F.when(key == name, F.lit(text)).otherwise(out)
    return F.when(raw == "", F.lit(NO_REASON)).otherwise(out)


def is_label(label: Column, unlabelled: Sequence[str] = ("", "Unknown", "Ambiguous", "Unlabeled", "nan")) -> Column:
    """Whether a predicted label names something."""
    return ~F.coalesce(F.trim(label), F.lit("")).isin(*unlabelled)


def neural_prior(columns: Sequence[str]) -> Column:
    """Whether any of the known metadata columns speaks for neural tissue."""
    out = F.lit(False)
    for c in NEURAL_COLUMNS:
        if c in columns:
            out = out | F.coalesce(F.rlike(F.col(c).cast("string"), F.lit(NEURAL)), F.lit(False))
    return out


def sample_folder(name: Column) -> tuple[Column, Column]:
    """(state, suffix) of a folder named Time-Condition-Replicate: the second part, or the whole name; the rest joined by '-'."""
    parts = F.split(name, "-")
    state = F.coalesce(F.try_element_at(parts, F.lit(2)), name)
    return state, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), "-")

"""Scalar expressions: hashes, seeds, natural order, distances, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def derive_seed(seed: int, *parts: Column) -> Column:
    """The first four bytes of the SHA-256 of a JSON list of the seed and the parts as strings, as an unsigned number."""
    texts = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])) if parts else F.lit("[]")
    text = F.concat(F.lit(f"[{seed}" + ("," if parts else "")), F.substring(texts, 2, 1 << 30))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def natural_key(text: Column) -> Column:
    """An array that orders texts with numbers as people do."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    key = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p)))
    return F.when(text.rlike(r"^\d"), F.concat(F.array(F.lit("")), key)).otherwise(key)


def subject_key(text: Column) -> Column:
    """Numeric ids first, by value; then the others."""
    number = text.rlike(r"^[0-9]+$")
    return F.struct((~number).alias("other"), text.try_cast("long").alias("n"), text.alias("s"))


def normal_id(text: Column) -> Column:
    """Integral numbers without their fraction; others trimmed."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def trial_uid(dataset: Column, subject: Column, session: Column, run: Column, index: Column) -> Column:
    return F.format_string("%s:%s:%s:%s:%05d", dataset, subject, session, run, index)


def close(a: Column, b: Column, rtol: float = 1e-12, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def encode_labels(text: Column, zero: str, one: str) -> Column:
    """0 and 1 for the two labels, in any case and with blanks around; any other raises."""
    t = F.lower(F.trim(text))
    return F.when(t == zero, 0).when(t == one, 1).otherwise(F.raise_error(F.concat(F.lit(f"a label is neither {zero} nor {one}: "), F.coalesce(text, F.lit("null")))).cast("int"))


def safe_name(text: Column) -> Column:
    """A file name of a display name."""
    return F.replace(F.replace(text, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))


def subject_directory(root: str, dataset: Column, subject: Column) -> Column:
    return F.concat_ws("/", F.lit(root), dataset, F.concat(F.lit("subject-"), normal_id(subject.cast("string"))))


def absent(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def number_text(x: Column, digits: int = 3) -> Column:
    return F.when(absent(x), "--").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def p_text(p: Column, tex: bool = False) -> Column:
    return F.when(absent(p), "--").when(p < 0.001, "$<$0.001" if tex else "<0.001").otherwise(number_text(p))


def holm_label(p: Column) -> Column:
    return F.when(absent(p), "Holm p = --").when(p < 0.001, "Holm p < 0.001").otherwise(F.concat(F.lit("Holm p = "), number_text(p)))


def significance(p: Column) -> Column:
    return F.when(~absent(p) & (p < 0.05), "*").otherwise("")


#: What LaTeX writes for characters of plain text, in the order of replacement.
TEX = (("\\", r"\textbackslash{}"), ("_", r"\_"), ("%", r"\%"), ("&", r"\&"), ("#", r"\#"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("×", r"$\times$"))


def tex_escape(text: Column) -> Column:
    for plain, written in TEX:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text

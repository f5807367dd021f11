"""Column functions over aligned sequences and headers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 20 residues, and the two symbol orders in use (gap first, codes from 1; gap last).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
GAP_FIRST = "-" + RESIDUES
GAP_LAST = RESIDUES + "-"
STATES = 21


def is_clean(seq: Column) -> Column:
    """Whether every symbol is a residue or a gap; a row that isn't is rejected whole."""
    return seq.rlike(f"^[-{RESIDUES}]+$")


def codes(seq: Column, order: str = GAP_FIRST) -> Column:
    """array<int> of symbol codes, from 1; 0 for a symbol that has none."""
    return F.transform(F.split(seq, ""), lambda s: F.instr(F.lit(order), s))


def letter_shares(text: Column, letters: str) -> Column:
    """A sequence of one site for each letter (ASCII): its share of the text's code points in half percents, up to 20, as a symbol of GAP_FIRST.

    A text's bytes are counted once, whatever the number of letters; null stays null.
    """

    def sites(t: pa.Array) -> pa.Array:
        return _letter_sites(t, letters)

    return F.arrow_udf(sites, "string")(text)


def _letter_sites(t: pa.Array, letters: str) -> pa.Array:
    t = t.cast(pa.large_binary())
    _, off, data = t.buffers()
    off = np.frombuffer(off, np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    count = np.zeros((len(t), 256), np.int64)
    for row, a, b in zip(count, off[:-1].tolist(), off[1:].tolist()):
        for x in range(a, b, 1 << 20):
            row += np.bincount(data[x : min(x + (1 << 20), b)], minlength=256)
    points = count.sum(axis=1) - count[:, 0x80:0xC0].sum(axis=1)  # all bytes but those that continue a code point
    at = np.minimum(200 * count[:, [ord(c) for c in letters]] // np.maximum(points, 1)[:, None], STATES - 1)
    made = np.frombuffer(GAP_FIRST.encode(), np.uint8)[at]
    ends = np.arange(len(t) + 1, dtype=np.int32) * len(letters)
    return pa.StringArray.from_buffers(len(t), pa.py_buffer(ends), pa.py_buffer(made.tobytes()), None if not t.null_count else t.is_valid().buffers()[1])


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def species_second_field(header: Column) -> Column:
    """Second |-separated field; null if there is none."""
    return F.try_element_at(F.split(header, "[|]"), F.lit(2))


def species_mnemonic(header: Column) -> Column:
    """Last |-field, up to /, after its last _ (all of it if there is none)."""
    return _last(F.split(F.element_at(F.split(_last(F.split(header, "[|]")), "/"), 1), "_"))


def species_bare(header: Column) -> Column:
    """Up to /, after the last _."""
    return _last(F.split(F.element_at(F.split(header, "/"), 1), "_"))


def species_third_field(header: Column) -> Column:
    """Third |-field, up to /, after its last _; null if there is none."""
    return _last(F.split(F.try_element_at(F.split(F.try_element_at(F.split(header, "[|]"), F.lit(3)), "/"), F.lit(1)), "_"))


def is_placeholder(code: Column, strict: bool = True) -> Column:
    """Codes that stand for no species: a leading digit, UNC or UNK anywhere; not strict: a leading digit or UNC."""
    return code.rlike("^[0-9]") | (code.contains("UNC") | code.contains("UNK") if strict else code.startswith("UNC"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def kv_scalar(line: Column, key: str) -> Column:
    """key=number in a log line as double (f exponents included); null if absent."""
    raw = F.regexp_extract(line, rf"(?:^|\s){key}=([-+0-9.eEfNaInf]+)", 1)
    return F.regexp_replace(raw, "f", "e").try_cast("double")


def kv_array(line: Column, key: str) -> Column:
    """key=[a, b] (with or without a type before the bracket) as array<double>; empty if absent."""
    body = F.regexp_extract(line, rf"(?:^|\s){key}=\w*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), "f", "e").try_cast("double")), lambda x: x.isNotNull())


def kv_map(line: Column, key: str) -> Column:
    """key=(x = 1, y = 2) as map<string, double>."""
    body = F.regexp_extract(line, rf"(?:^|\s){key}=\(([^)]*)\)", 1)
    return F.transform_values(F.str_to_map(F.regexp_replace(body, r"\s", ""), F.lit(","), F.lit("=")), lambda _, v: F.regexp_replace(v, "f", "e").try_cast("double"))


def config_text(config: dict) -> str:
    """key=value in order of the keys, joined by _; keys that are None are left out."""
    return "_".join(f"{k}={config[k]}" for k in sorted(config) if config[k] is not None)


def config_tag(config: dict) -> str:
    """A short stable name of a configuration."""
    return hashlib.md5(config_text(config).encode()).hexdigest()[:16]


def config_tag_of(cols: dict[str, Column]) -> Column:
    """config_tag() of each row's values; null ones are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in sorted(cols.items())]
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)


def single_model_path(path: Column, tag: str) -> Column:
    """rbm_<tag>_... beside rbm_paired_..._PAIRED_ITERS=<n>.<ext>, without what only the paired model depends on; null if the name is another."""
    dir_, base = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    middle = F.nullif(F.regexp_extract(base, r"^rbm_paired_(.*)_PAIRED_ITERS=\d+\.\w+$", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(middle, r"_H_ADD=\d+", ""), r"_NITERSB=\d+", "")
    return F.concat(dir_, F.lit(f"rbm_{tag}_"), bare, F.lit("."), F.element_at(F.split(base, r"\."), -1))

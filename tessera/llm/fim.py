"""Fill-in-middle transformation with cuts found in a compressed boundary set.

The texts of a batch lie one after the other in one buffer. The byte offsets at
which a unit (code point, word or line) starts form one ``BoundarySet``; the unit
count of a text is a difference of ranks, and both cuts are selects, so no text
is decoded. Prefix, middle and suffix are then byte slices:

* ``psm``   <P>prefix<S>suffix<M>middle
* ``spm``   <S>suffix<P>prefix<M>middle
* ``plain`` the text as it is

A document's draws are the first four 8-digit groups of
sha256("<seed>:<identifier>"): two cuts, the share that stays plain and the share
of spm. They depend on nothing else, so a recomputed partition repeats them.

Words include the white space behind them, lines their line feed; white space at
the start of a text is a word unit of its own.

Defined cases: NULL text counts as empty and stays plain, with 0 units; texts that
hold a sentinel stay plain; a NULL identifier hashes as an empty one; repeated rows
get equal results; an empty table gives no rows. Input columns are kept, with one
struct column ``fim`` (form, n, prefix_units, middle_units, output); an input column
of that name is refused. Long texts are cut whole; batches hold about 8 MB of text or
one text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tessera.llm.boundaries import BoundarySet
from tessera.llm.common import strings, text_slices

#: (prefix, suffix, middle)
SENTINELS = ("<P>", "<S>", "<M>")
FIM_RATE, SPM_RATE = 90, 20
SEED = 1
FIM_TYPE = "struct<form:string,n:bigint,prefix_units:bigint,middle_units:bigint,output:string>"


def draws(id_col: str, seed: int = SEED) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def unit_starts(data: np.ndarray, ends: np.ndarray, unit: str) -> np.ndarray:
    """Mask over the buffer and its end: True where a unit, or a text that is not empty, starts."""
    mask = np.ones(len(data) + 1, dtype=bool)
    if unit == "char":
        mask[:-1] = (data & 0xC0) != 0x80
        return mask
    if unit == "word":
        space = (data == 32) | ((data >= 9) & (data <= 13))
        mask[1:-1] = ~space[1:] & space[:-1]
    elif unit == "line":
        mask[1:-1] = data[:-1] == 10
    else:
        raise ValueError(f"unknown unit {unit!r}")
    mask[ends[:-1]] = True
    return mask


def transform_batch(text: pa.Array, draw: np.ndarray, unit: str, rates, sentinels) -> pa.Array:
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    buffer = text.buffers()[2]
    raw = (buffer.to_pybytes() if buffer is not None else b"")[ends[0]:ends[-1]]
    ends = ends - ends[0]
    found = BoundarySet(unit_starts(np.frombuffer(raw, dtype=np.uint8), ends, unit))
    first = found.rank(ends)
    n = np.diff(first)
    a, b = draw[:, 0] % (n + 1), draw[:, 1] % (n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    # the member behind a text's last unit is the start of the next text that has one, or the end
    cut1, cut2 = found.select(first[:-1] + lo), found.select(first[:-1] + hi)
    p, s, m = (x.encode() for x in sentinels)
    fim = (n > 0) & (draw[:, 2] % 100 < rates[0])
    spm = draw[:, 3] % 100 < rates[1]
    forms, outputs = [], []
    for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        whole = raw[x:y]
        if not fim[i] or p in whole or s in whole or m in whole:
            fim[i] = False
            forms.append("plain")
            outputs.append(whole)
            continue
        u, v = int(cut1[i]), int(cut2[i])
        forms.append("spm" if spm[i] else "psm")
        outputs.append(b"".join((s, raw[v:y], p, raw[x:u], m, raw[u:v]) if spm[i]
                                else (p, raw[x:u], s, raw[v:y], m, raw[u:v])))
    return pa.StructArray.from_arrays(
        [pa.array(forms, pa.string()), pa.array(n, pa.int64()), pa.array(lo, pa.int64(), mask=~fim),
         pa.array(hi - lo, pa.int64(), mask=~fim), pa.array(outputs, pa.binary()).cast(pa.string())],
        names=["form", "n", "prefix_units", "middle_units", "output"])


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char",
                   rates=(FIM_RATE, SPM_RATE), sentinels=SENTINELS, seed: int = SEED) -> DataFrame:
    """The input columns and ``fim``; ``rates`` are percentages (transformed, spm of those)."""
    if "fim" in df.columns:
        raise ValueError("the input already has a column 'fim'")
    names, drawn, work = list(df.columns), "draws", "work_text"
    while drawn in names:
        drawn += "_"
    while work in names:
        work += "_"
    sent = df.withColumn(work, F.col(text_col).cast("string")).withColumn(drawn, draws(id_col, seed))
    schema = StructType([*df.schema.fields, StructField("fim", _parse_datatype_string(FIM_TYPE))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, work):
                draw = part.column(drawn).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                out = transform_batch(strings(part, work), draw, unit, rates, sentinels)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), out], names=[*names, "fim"])

    return sent.mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The exact text of an output: a transformed text holds no sentinel of its own."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    prefix, suffix = F.when(form == "spm", parts[2]).otherwise(parts[1]), F.when(form == "spm", parts[1]).otherwise(parts[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def _draw_sql(i: int) -> str:
    return f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, length(x)::BIGINT AS n FROM t),
c AS (SELECT *, least({_draw_sql(0)} % (n + 1), {_draw_sql(1)} % (n + 1)) AS lo,
    greatest({_draw_sql(0)} % (n + 1), {_draw_sql(1)} % (n + 1)) AS hi,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR {_draw_sql(2)} % 100 >= {FIM_RATE}
      THEN 'plain' WHEN {_draw_sql(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM n),
o AS (SELECT *, substr(x, 1, lo) AS p, substr(x, lo + 1, hi - lo) AS m, substr(x, hi + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM o
"""

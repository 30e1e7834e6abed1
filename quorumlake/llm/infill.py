"""Fill-in-middle transformation: texts cut at two unit boundaries and put together in another order.

Each lot of texts becomes one row of character classes, held in a wavelet matrix
over its UTF-8 bytes. A unit starts at every byte of certain classes, so that the
units before a place are the ranks of these classes added up; so are the
characters. A cut after k units is the place where unit k + 1 starts, found for
all texts of the lot at once by bisection on the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lots, text_bytes, with_text
from .wavelet import WaveletMatrix

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages of the texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Bytes of text whose classes are held together.
LOT_BYTES = 4 << 20

#: Classes of bytes, those that start no character or no token first.
CONTINUATION, IN_WORD, WORD_START, OTHER, LEAD = range(5)
DEPTH = 3
#: The classes that start a unit.
UNITS = {"token": range(WORD_START, LEAD + 1), "character": range(IN_WORD, LEAD + 1)}
CHARACTERS = UNITS["character"]

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = WORD_START
_CLASS[128:192] = CONTINUATION
_CLASS[192:] = LEAD


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one after the other and begin at starts."""
    found = _CLASS[data]
    letter = found == WORD_START
    inner = letter[1:] & letter[:-1]
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    found[1:][inner & ~begins[1:-1]] = IN_WORD
    return found


def cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "token") -> tuple[np.ndarray, ...]:
    """(units, prefix bytes, middle bytes, prefix characters, middle characters) of each text, given its bounds in data and two hashes."""
    first, end = bounds[:-1], bounds[1:]
    matrix = WaveletMatrix(classes(data, first), DEPTH)
    start_rank = matrix.rank(UNITS[unit], first)
    units = matrix.rank(UNITS[unit], end) - start_rank
    one, two = h1 % (units + 1), h2 % (units + 1)

    def place(taken: np.ndarray) -> np.ndarray:
        # Unit taken + 1 starts one byte before as many are counted; beyond the last unit there is the text's end.
        found = matrix.select(UNITS[unit], start_rank + taken + 1, first, end)
        return np.where(taken < units, found - 1, end)

    a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
    chars = [matrix.rank(CHARACTERS, p) for p in (first, a, b)]
    return units, a - first, b - a, chars[1] - chars[0], chars[2] - chars[1]


def hashes(id_col: str, seed: int = 1) -> list[Column]:
    """The first four groups of eight hex digits of a digest of seed and id, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """documents' columns (or keep) plus n, form, prefix_chars, middle_chars and output.

    Units are runs of ASCII letters and other single characters ("token") or all
    characters ("character"); n counts them. Two hashes of seed and id say after
    how many units prefix and middle end, a third whether the text stays plain,
    a fourth whether the suffix goes before the prefix (form spm, else psm). Empty
    texts and those that hold one of the marks stay plain, and have null lengths.
    A null text counts as empty. Rows with the same id and text give the same
    output; those with a null id are cut alike. No rows give no rows. Names that
    the documents have already are taken by the new columns only if those don't
    belong to keep; otherwise the new ones get a leading underscore.
    """
    kept = documents.columns if keep is None else keep
    h = [free_name(f"h{k}", documents) for k in range(1, 5)]
    held, text_at, n_kept = with_text(documents.withColumns(dict(zip(h, hashes(id_col, seed), strict=True))), text_col, [*kept, *h])
    n_kept -= len(h)
    fields = list(held.schema)[:n_kept]
    new = [free_name(c, documents.select(*[F.col(f"`{k}`") for k in kept])) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    kinds = ("long", "string", "long", "long", "string")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{c}` {k}" for c, k in zip(new, kinds, strict=True)])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for start, stop in lots(batch.column(text_at), LOT_BYTES):
                part = batch.slice(start, stop - start)
                texts = part.column(text_at)
                data, bounds = text_bytes(texts)
                h1, h2, h3, h4 = (c.to_numpy(zero_copy_only=False) for c in part.columns[n_kept : n_kept + 4])
                units, before, middle, prefix_chars, middle_chars = cuts(data, bounds, h1, h2, unit)
                filled = pc.fill_null(texts, "")
                marked = pc.match_substring_regex(filled, "|".join((PREFIX, SUFFIX, MIDDLE))).to_numpy(zero_copy_only=False)
                plain = marked | (units == 0) | (h3 % 100 >= PLAIN_FROM)
                spm = h4 % 100 < SUFFIX_FIRST_BELOW
                raw, out = memoryview(data).cast("B"), []
                for k in range(stop - start):
                    a, z = int(bounds[k]), int(bounds[k + 1])
                    i = a + int(before[k])
                    j = i + int(middle[k])
                    if plain[k]:
                        out.append(bytes(raw[a:z]))
                    elif spm[k]:
                        out.append(b"".join((s, raw[j:z], p, raw[a:i], m, raw[i:j])))
                    else:
                        out.append(b"".join((p, raw[a:i], s, raw[j:z], m, raw[i:j])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                lengths = [pa.array(x, pa.int64(), mask=plain) for x in (prefix_chars, middle_chars)]
                columns = [pa.array(units, pa.int64()), pa.array(form.tolist(), pa.string()), *lengths, pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *columns], [f.name for f in fields] + new)

    return held.mapInArrow(made, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made output from; null gives null."""

    def part(after: Column, mark: str, before: Column | None = None) -> Column:
        start = after + len(mark)
        return F.substring(output, start, F.char_length(output) if before is None else before - start)

    def at(mark: str) -> Column:
        return F.instr(output, F.lit(mark))

    psm = F.concat(part(at(PREFIX), PREFIX, at(SUFFIX)), part(at(MIDDLE), MIDDLE), part(at(SUFFIX), SUFFIX, at(MIDDLE)))
    spm = F.concat(part(at(PREFIX), PREFIX, at(MIDDLE)), part(at(MIDDLE), MIDDLE), part(at(SUFFIX), SUFFIX, at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

"""Quality rules from repetition: characters inside duplicated word n-grams and duplicated lines.

Rolling hashes of several n-gram lengths are taken over each whole text at once in numpy. An n-gram
counts as duplicated if its hash occurs twice in the same text; a character counts once however many
duplicated n-grams cover it. A text of null is the empty text; it has no words and fails the base
rule. Rows are independent: repeated rows and ties give equal results, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import register, table
from .textops import BYTE_BASE, BYTE_VALUES, Words, mix, span_hash, word_slices

#: Largest share of word characters inside duplicated n-grams, by n; longer repeats weigh more. The
#: first value is that of the base rule, so that a single repeated sentence does not reject a text.
GRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = [
    ("doc_id", "long"), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
    ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
    ("dup_line_chars", "long"), *[(f"dup_chars_{n}", "long") for n in GRAM_LIMITS], ("kept", "boolean"),
]


def covered(words: Words, hashes: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-gram that its document holds twice or more."""
    keys = (words.grams(hashes, n) ^ salt)[ok := words.whole(n)]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    delta = np.zeros(len(hashes) + n + 1, dtype=np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        starts = np.flatnonzero(ok)[twice[at] == keys]
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + n, -1)
    return np.cumsum(delta)[: len(hashes)] > 0


def per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    """Sum of word values by document."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[words.doc_words[1:]] - total[words.doc_words[:-1]]


def repeated_lines(words: Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines equal to an earlier line, and the word characters in them."""
    cuts = np.flatnonzero(words.data == 10)
    starts = np.unique(np.concatenate((words.bounds[:-1], cuts + 1)))
    starts = starts[starts < words.bounds[-1]]
    doc = np.searchsorted(words.bounds, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], words.bounds[-1]), words.bounds[doc + 1])
    ends = np.where((ends > starts) & (words.data[ends - 1] == 10), ends - 1, ends) if len(ends) else ends
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    full = last > first
    starts, ends, doc, first, last = (x[full] for x in (starts, ends, doc, first, last))
    keys = span_hash(BYTE_VALUES[words.data], starts, ends, BYTE_BASE) ^ mix(doc.astype(np.uint64))
    _, earliest, inverse = np.unique(keys, return_index=True, return_inverse=True)
    again = earliest[inverse] != np.arange(len(keys))
    total = np.concatenate(([0], np.cumsum(chars)))
    inside = (total[last] - total[first])[again]
    return (
        np.bincount(doc[again], minlength=words.docs),
        np.bincount(doc[again], weights=inside, minlength=words.docs).astype(np.int64),
    )


def measure(words: Words) -> list[np.ndarray]:
    """The columns after doc_id, one value per document."""
    hashes = words.hashes()
    salt = mix(words.doc_of_word().astype(np.uint64))
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    chars = points[words.ends] - points[words.starts]
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[words.data])))
    n_words, word_chars = words.counts(), per_doc(words, chars)
    n_symbols = marks[words.bounds[1:]] - marks[words.bounds[:-1]]
    n_lines, line_chars = repeated_lines(words, chars)
    in_five, inside = None, []
    for n in GRAM_LIMITS:
        mask = covered(words, hashes, salt, n)
        in_five = mask if n == 5 else in_five
        inside.append(per_doc(words, chars * mask))
    n_repeat = per_doc(words, in_five)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~failed & (line_chars <= LINE_LIMIT * word_chars)
    for limit, c in zip(GRAM_LIMITS.values(), inside):
        kept &= c <= limit * word_chars
    return [n_words, word_chars, n_symbols, n_lines, n_repeat, failed, line_chars, *inside, kept]


def repetition(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, coverage by n-gram length, the base rule and the verdict."""

    def scan(batches):
        for batch in batches:
            for words in word_slices(batch.column(1)):
                columns = [pa.array(x, pa.bool_() if x.dtype == bool else pa.int64()) for x in measure(words)]
                ids = batch.column(0).slice(words.first, words.docs).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[f for f, _ in FIELDS])

    return docs.select("doc_id", "text").mapInArrow(scan, ", ".join(f"{a} {b}" for a, b in FIELDS))


def _repetition_sql() -> str:
    """All columns by windows over the words of a text."""
    counts = ", ".join(f"coalesce(sum(length(x)) filter (in_{n}), 0)::bigint dup_chars_{n}" for n in GRAM_LIMITS)
    inside = ", ".join(
        # a word is covered if a repeated window starts at it or up to n - 1 words before
        f"coalesce(max(twice_{n}::int) over (partition by doc_id order by i rows between {n - 1} preceding and current row), 0) = 1 in_{n}"
        for n in GRAM_LIMITS
    )
    grams = ", ".join("x || ' ' || " + " || ' ' || ".join(f"lead(x, {k}) over o" for k in range(1, n)) + f" gram_{n}" for n in GRAM_LIMITS)
    twice = ", ".join(f"gram_{n} is not null and count(*) over (partition by doc_id, gram_{n}) > 1 twice_{n}" for n in GRAM_LIMITS)
    kept = " and ".join(f"dup_chars_{n} <= {limit!r}::double * word_chars" for n, limit in GRAM_LIMITS.items())
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {word}) w from documents),
p as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from d),
m as (select doc_id, i, x, {grams} from p window o as (partition by doc_id order by i)),
q as (select doc_id, i, x, {twice} from m),
c as (select doc_id, x, {inside} from q),
g as (select doc_id, count(*)::bigint n_words, sum(length(x))::bigint word_chars, count_if(in_5)::bigint n_repeat_words, {counts} from c group by doc_id),
ls as (select doc_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) k from d),
lw as (select doc_id, row_number() over (partition by doc_id, line order by k) > 1 again, length(array_to_string(regexp_extract_all(line, {word}), '')) chars
  from ls where len(regexp_extract_all(line, {word})) > 0),
lg as (select doc_id, count_if(again)::bigint n_dup_lines, coalesce(sum(chars) filter (again), 0)::bigint dup_line_chars from lw group by doc_id),
j as (select d.doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(word_chars, 0)::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(dup_line_chars, 0)::bigint dup_line_chars,
  {", ".join(f"coalesce(dup_chars_{n}, 0)::bigint dup_chars_{n}" for n in GRAM_LIMITS)}
  from d left join g on d.doc_id = g.doc_id left join lg on d.doc_id = lg.doc_id)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and dup_line_chars <= {LINE_LIMIT!r}::double * word_chars and {kept} kept from j"""


@register("op5_repetition_coverage", _repetition_sql())
def op5(spark, sf_dir):
    return repetition(table(spark, sf_dir, "documents"))

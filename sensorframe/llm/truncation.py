"""Texts cut off by field limits or broken transfers: a backward character n-gram model of endings, then an exact check."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

ORDER = 7  # characters of the longest context
SPAN = 4_000_000  # characters whose contexts are counted together
COMMON = 254  # characters of a span that get a byte of their own
FILTER_BITS = 26  # the filter of wanted contexts has 2 ** FILTER_BITS bits (8 MB), whatever the corpus
SMOOTH = 2.0
START = 0.02  # share of endings before any context is known
WORD_START = 0.2  # and of ends of words
PRIOR = 100.0  # samples that what is known of all languages counts for in one of them
LOW, HIGH, WIDTH = -30.0, 15.0, 0.5  # bins of scores
OMISSIONS = ("…", "...", "&hellip;", "[…]", "[...]")
STOPS, CLOSERS = frozenset(".!?。！？।؟۔…‽"), "'\"”»’)]」』»‬‏"
WHOLE = re.compile(r"^\s*(?:\[{1,2}[^\[\]]*\]\]|\{\{.*\}\}|==.*==|\|\}|#[^\s\[]*:?\s*\[\[[^\[\]]+\]\]|<[^<>]+>|__\w+__|\|-+)$")
WORD = re.compile(r"[^\W\d_]+(?:[^\s\w(),:;\[\]&|]*[^\W\d_]+)*")
TAG = re.compile(r"</?(?:[a-zA-Z]+(?:\s[^<>]*)?)?")
ENTITY = re.compile(r"&[a-zA-Z#]\w{0,7}$")
#: Kinds of lines by their first character.
KINDS = ("*#:;", "|!", "[", "=", "{", "<")
#: Classes of endings, see ending_class.
ENDINGS = ("inside", "open", "whole", "same", "other", "plain")


def bare_end(text: str) -> str:
    """`text` without white space and marks of omission at its end."""
    while True:
        short = text.rstrip()
        for mark in OMISSIONS:
            if short.endswith(mark):
                short = short[: -len(mark)]
                break
        else:
            return short
        text = short


def _kinds() -> np.ndarray:
    table = np.zeros(128, np.uint64)
    for i, chars in enumerate(KINDS):
        for c in chars:
            table[ord(c)] = i + 1
    return table


def _characters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, line kinds, which of the text's they are): a run of digits counts as one 0, carriage returns as nothing."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digit = (a >= 48) & (a <= 57)
    keep = ~(digit & np.r_[False, digit[:-1]]) & (a != 13)
    a = a[keep]
    c = np.where((a >= 48) & (a <= 57), 48, a).astype(np.uint64)
    line = np.maximum.accumulate(np.where(a == 10, np.arange(len(a)) + 1, 0))
    first = np.r_[0, line[:-1]] if len(a) else line
    kinds = _kinds()[np.minimum(c[np.minimum(first, max(len(a) - 1, 0))], 127).astype(np.int64)] if len(a) else c
    return c, kinds, keep


def _hash(nearest_first: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
    """The bit of the filter for each context."""
    h = kind.astype(np.uint64) + np.uint64(17)
    for c in nearest_first:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _groups(c: np.ndarray, kind: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, a position of each context, times, endings, ends of words) for each length of contexts that end at positions `at`.

    Characters become numbers of this text, and as many as 62 bits hold are sorted together; then the ranks stand for
    them. So contexts are told apart by their characters, not by a hash.
    """
    there = np.zeros(0x110000, bool)
    there[c] = True
    letter = np.zeros(0x110000, bool)
    letter[[x for x in np.flatnonzero(there).tolist() if in_word(chr(x))]] = True
    ends = (c[at + 1] == 10).astype(np.int64) + ((letter[c[at]] & ~letter[c[at + 1]]).astype(np.int64) << 32)  # both in one number
    code = (np.cumsum(there) - 1)[c]
    bits = int(there.sum()).bit_length()
    rank, held, length = kind[at].astype(np.int64), 3, 0
    while length < ORDER:
        m = min(ORDER - length, (62 - held) // bits)
        x = rank
        for k in range(m):
            x = x << bits | code[at - length - k]
        order = np.argsort(x)
        x, e = x[order], ends[order]
        for k in range(1, m + 1):
            y = x >> bits * (m - k)
            first = np.r_[True, y[1:] != y[:-1]]
            heads = np.flatnonzero(first)
            both = np.add.reduceat(e, heads)
            yield length + k, at[order[heads]], np.diff(np.append(heads, len(at))), both & 0xFFFFFFFF, both >> 32
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(first) - 1
        held, length = len(at).bit_length(), length + m


def _tally(c: np.ndarray, kind: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters nearest first, line kinds, times, endings, ends of words) of the contexts of each length that end at
    positions `at`, which have ORDER characters before them. A context may come in two parts.

    Where all characters of a context are among the COMMON commonest, they, the line's kind and what follows fit one
    number, so a plain sort counts all lengths; the rest goes through _groups.
    """
    often = np.bincount(c)
    seen = np.flatnonzero(often)
    seen = seen[np.argsort(-often[seen], kind="stable")][:COMMON]
    code = np.full(len(often), 255, np.uint8)
    code[seen] = np.arange(len(seen))
    b = code[c]
    rare = np.cumsum(b == 255)
    slow = rare[at] > rare[at - ORDER]
    for length, where, n, e, w in _groups(c, kind, at[slow]) if slow.any() else ():
        yield [c[where - j] for j in range(length)], kind[where], n, e, w
    at = at[~slow]
    if not len(at):
        return
    letter = np.zeros(len(often), bool)
    letter[[x for x in np.flatnonzero(often).tolist() if in_word(chr(x))]] = True
    x = kind[at].astype(np.int64)
    for j in range(ORDER):
        x = x << 8 | b[at - j]
    x = x << 2 | (letter[c[at]] & ~letter[c[at + 1]]).astype(np.int64) << 1 | (c[at + 1] == 10)
    x.sort()
    n, e, w, u = np.ones(len(x), np.int64), x & 1, x >> 1 & 1, x >> 2
    for length in range(ORDER, 0, -1):
        heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        n, e, w, u = np.add.reduceat(n, heads), np.add.reduceat(e, heads), np.add.reduceat(w, heads), u[heads]
        yield [seen[u >> 8 * (length - 1 - j) & 255] for j in range(length)], u >> 8 * length, n, e, w
        u = u >> 8


def _keys(nearest_first: list[np.ndarray], kind: np.ndarray) -> pa.Array:
    """The contexts' characters in reading order, and the digit of the line's kind."""
    length = len(nearest_first)
    text = np.empty((len(kind), length + 1), np.uint32)
    for k, c in enumerate(nearest_first):
        text[:, length - 1 - k] = c
    text[:, length] = kind.astype(np.uint32) + np.uint32(48)
    keys = text.view(f"<U{length + 1}").ravel()
    return pa.array(keys if text.all() else keys.tolist(), pa.string())  # Arrow reads numpy's texts up to the first zero character


def _parts(t: str) -> Iterator[tuple[str, int, int]]:
    """(text, first, end): the text, or the lines of a long one, with ORDER characters before them, which aren't counted."""
    i = 0
    while i < len(t):
        end = len(t) if len(t) - i <= SPAN else t.find("\n", i + SPAN) + 1 or len(t)
        a = max(0, i - ORDER)
        while a and len(plain(t[a:i])) <= ORDER:
            a = max(0, i - 2 * (i - a))
        yield t[a:end], i - a, end - a
        i = end


def _count(batches: Iterator[pa.RecordBatch], wanted: Callable[[], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The contexts of every length at all positions of the texts but spaces: key, times, and times at the end of a line or
    text and of a word. With `wanted`, contexts whose bit isn't set are left out once they are counted."""
    pad = "\n" * (ORDER + 1)
    bits = wanted() if wanted else None

    def count(pieces: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        text = pad + pad.join(t for t, _, _ in pieces) + pad
        counted, at = np.zeros(len(text), bool), 0
        for t, a, b in pieces:
            at += len(pad)
            counted[at + a : at + b] = True
            at += len(t)
        c, kind, keep = _characters(text)
        c = c.astype(np.int64)
        at = np.flatnonzero(counted[keep] & ~np.isin(c, [9, 10, 32, 160]))
        if not len(at):
            return
        for chars, kinds, n, e, w in _tally(c, kind, at):
            if bits is not None:
                bit = _hash(chars, kinds)
                use = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                chars, kinds, n, e, w = [x[use] for x in chars], kinds[use], n[use], e[use], w[use]
            if len(n):
                yield pa.RecordBatch.from_arrays([_keys(chars, kinds), *(pa.array(x, pa.int64()) for x in (n, e, w))], ["key", "n", "e", "w"])

    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for part in _parts(bare_end(text) if text else ""):
                held.append(part)
                size += len(part[0])
                if size > SPAN:
                    yield from count(held)
                    held, size = [], 0
    if held:
        yield from count(held)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the filter for all lengths of each context."""
    for b in batches:
        if b.num_rows:
            text = np.array(b.column("context").to_pylist(), f"<U{ORDER + 1}").view(np.uint32).reshape(-1, ORDER + 1)
            chars = [text[:, ORDER - 1 - j] for j in range(ORDER)]
            bits = [_hash(chars[:n], text[:, ORDER] - np.uint32(48)) for n in range(1, ORDER + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bits)))], ["bit"])


def wanted_filter(contexts: DataFrame) -> np.ndarray:
    """A filter of fixed size: a byte array with a bit set for each context, of every length. What is not wanted passes
    where it shares a bit, so the more contexts the less it leaves out; no wanted context is ever left out."""
    rows = contexts.where("context is not null").select("context").mapInArrow(_bits, "bit long")
    page = F.floor(F.col("bit") / 32768)
    pages = rows.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in pages.collect():  # at most 2 ** FILTER_BITS / 32768 rows of 4 KB
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def count_contexts(documents: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """key, n, e and w: how often each context of one to ORDER characters stands in the texts, at an end, at a word's end.

    Every position of every text counts, exactly and at any size of the corpus. A key is the context's characters in
    reading order and the digit of its line's kind. A context ends where a line or text does; marks of omission at the
    end of a text are taken off first, so what stands before them counts as an ending. With `contexts`, counts of others
    are mostly left out before the shuffle, by a filter of 8 MB.
    """
    wanted = None
    if contexts is not None:
        shared = documents.sparkSession.sparkContext.broadcast(wanted_filter(contexts))
        wanted = lambda: shared.value
    return documents.select("text").mapInArrow(partial(_count, wanted=wanted), "key string, n long, e long, w long").groupBy("key").agg(*(F.sum(x).alias(x) for x in "new"))


def in_word(c: str) -> bool:
    """Whether a character is a letter or a mark on one."""
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def plain(t: str) -> str:
    """A text as _characters sees it."""
    return re.sub("[0-9]+", "0", t).replace("\r", "")


def final_context(t: str) -> str | None:
    """The key of the last ORDER characters of a text, None if it is empty; before a text are line ends."""
    if not t:
        return None
    width = 4 * ORDER
    while width < len(t) and len(plain(t[-width:])) <= ORDER:
        width *= 2
    first = plain(t[t.rfind("\n") + 1 :][:100].lstrip("\r"))[:1]
    kind = next((i + 1 for i, chars in enumerate(KINDS) if first and first in chars), 0)
    return ("\n" * ORDER + plain(t[-width:]))[-ORDER:] + str(kind)


def context_odds(contexts: DataFrame, counts: DataFrame) -> DataFrame:
    """context, ends (whether it stands at an end), odds and word_odds: the log-odds of an ending against a continuation
    after each context, and those of a word's end against more letters; the context's own occurrence is left out.

    Longer contexts correct shorter ones as far as their counts reach. Only counts of `contexts` are looked up.
    """
    lengths = F.explode(F.sequence(F.lit(1), F.lit(ORDER)))
    wanted = contexts.where("context is not null").select("context").distinct().select("context", lengths.alias("length")).withColumn("key", F.expr("right(context, length + 1)"))
    less = lambda c, k: F.greatest(F.coalesce(c, F.lit(0)) - k, F.lit(0))

    def own(k: int) -> Column:
        """Counts but for one occurrence, which is an ending (1) or not (0)."""
        n = less("n", 1)
        return F.struct("length", n.alias("n"), F.least(less("e", k), n).alias("e"), F.least(less("w", k), n).alias("w"))

    found = wanted.join(counts, "key", "left").groupBy("context").agg(*[F.sort_array(F.collect_list(own(k))).alias(f"x{k}") for k in (0, 1)])

    def share(xs: str, start: float, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.lit(start), lambda q, x: (of(x) + SMOOTH * q) / (x["n"] + SMOOTH))

    def odds(xs: str, start: float, c: str) -> Column:
        return F.greatest(F.log(share(xs, start, lambda x: x[c])) - F.log(share(xs, 1 - start, lambda x: x["n"] - x[c])), F.lit(-1e6))

    both = F.array(*[F.struct(F.lit(k == 1).alias("ends"), odds(f"x{k}", START, "e").alias("odds"), odds(f"x{k}", WORD_START, "w").alias("word_odds")) for k in (0, 1)])
    return found.select("context", F.inline(both))


def open_part(t: str) -> str:
    """What stands open at the end of a text: link, template, note, tag, entity, table or heading; else ''."""
    line = t[t.rfind("\n") + 1 :]
    a = line.rfind("[[")
    if a >= 0 and "]]" not in line[a:]:
        return "link"
    a = t.rfind("{{")
    if a >= 0 and "}}" not in t[a:]:
        return "template"
    a = max(t.rfind(x) for x in ("<ref", "<REF", "<Ref"))
    if a >= 0 and "/>" not in t[a:]:
        low = t[a:].lower()
        if "</ref>" not in low and not low.startswith("<references"):
            return "note"
    a = line.rfind("<")
    if a >= 0 and TAG.fullmatch(line, a):
        return "tag"
    if ENTITY.search(line):
        return "entity"
    a = t.rfind("{|")
    if a >= 0 and "|}" not in t[a:] and line[:1] in tuple("|!{"):
        return "table"
    if re.match(r"=+[^=]", line) and not line.endswith("="):
        return "heading"
    return ""


def item_shape(line: str) -> str:
    """A list item with words, digits and links evened out."""
    plain = re.sub(r"\d+", "9", line.replace("[[", "").replace("]]", ""))
    return re.sub(r"\s+", " ", WORD.sub("a", plain)).strip()


def ending_class(t: str) -> str:
    """How a text without its marks of omission ends: 'broken' (half a character), 'inside' (a link, note, tag, entity or
    heading of the last line), 'open' (a template or table), 'whole' (a stop or a complete line), 'same' or 'other' (a list
    item with or without one of its shape right before it in the list), else 'plain'."""
    if t.endswith("�"):
        return "broken"
    line = t[t.rfind("\n") + 1 :]
    part = open_part(t)
    if part:
        return "open" if part in ("template", "table") or WHOLE.match(line) else "inside"
    if WHOLE.match(line) or line.endswith(("</ref>", "/>", "}}")) or line.rstrip(CLOSERS)[-1:] in STOPS:
        return "whole"
    if line[:1] in ("*", "#"):
        shape, at = item_shape(line), t.rfind("\n")
        while at > 0:
            start = t.rfind("\n", 0, at)
            before = t[start + 1 : at].rstrip("\r")
            if before[:1] not in ("*", "#"):
                break
            if item_shape(before) == shape:
                return "same"
            at = start
        return "other"
    return "plain"


def line_before(t: str) -> str:
    """A text up to the line end before its last line, '' if that ends no more than a line of a paragraph."""
    at = t.rfind("\n")
    before, last = t[: max(at, 0)], t[at + 1 :].strip()
    ends = not last or last[0] in "=*#:;|{<!" or WHOLE.match(last) or before.rstrip(" \t\r").endswith("\n")
    return before.rstrip() if ends else ""


SAMPLES = "doc_id long, language string, source string, sample string, context string, ends boolean, ending string, letter boolean"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to three rows a document: its own end ('final'), the line end before its last line ('line'), which is complete as
    far as anyone knows, and the end it would have if it were cut at a place that follows from its id ('cut').

    A line ends something only if what follows is blank, begins with markup or is a line of markup by itself; a paragraph
    goes on over other line breaks."""
    for b in batches:
        out: dict[str, list] = {x.split()[0]: [] for x in SAMPLES.split(", ")}
        for i, language, source, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "language", "source", "text"))):
            t = bare_end(text) if text else ""
            place = (((i or 0) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 20) % max(len(t), 1)
            for sample, x in (("final", t), ("line", line_before(t)), ("cut", bare_end(t[:place]))):
                if x or sample == "final":
                    for c, v in zip(out.values(), (i, language, source, sample, final_context(x), sample != "cut", ending_class(x) if x else "whole", in_word(x[-1:] or " "))):
                        c.append(v)
        kinds = {"doc_id": pa.int64(), "ends": pa.bool_(), "letter": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], list(out))


def language(lang: Column) -> Column:
    """The plain language code of a dirty one; 'und' if it has none."""
    clean = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("und")))), "^[a-z]{2,3}", 0)
    return F.when(clean == "", "und").otherwise(clean)


def ending_scores(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, language, source, sample, ending, odds and score of each document's own end and of its held-out ones (see
    _endings).

    odds are the log-odds that a text may end where this one does (null for empty texts), the score also takes off those
    against a word's end after a last letter; ending is the class of ending_class. The samples and their scores are
    written to the shared folder, each once, so the texts are read twice: for samples and for counts.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"), language(F.col("lang")).alias("language"), F.col("source").cast("string").alias("source"))

    def written(df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    samples = written(rows.mapInArrow(_endings, SAMPLES), "endings")
    odds = context_odds(samples, count_contexts(rows, samples))
    score = F.col("odds") + F.when(F.col("letter"), F.least("word_odds", F.lit(0.0))).otherwise(0.0)
    scored = samples.join(odds, ["context", "ends"], "left").select("doc_id", "language", "source", "sample", "ending", "odds", score.alias("score"))
    return written(scored, "scores")


def _spread(counts: np.ndarray, prior: np.ndarray, axes: int) -> np.ndarray:
    """Counts as shares over the last `axes` axes, with shares `prior` that count for PRIOR samples."""
    return (counts + PRIOR * prior) / (counts.sum(tuple(range(-axes, 0)), keepdims=True) + PRIOR)


def _mixture(final: np.ndarray, cut: np.ndarray, whole: np.ndarray, prior: tuple[float, np.ndarray] | None) -> tuple[float, np.ndarray]:
    """(share of cut texts, shares of complete ones by class) under which the final ends are likeliest, by expectation
    maximisation: final(class, bin) = share * cut(class, bin) + shares(class) * whole(class, bin)."""
    total, weight = final.sum(), PRIOR if prior else 1.0
    base = prior or (0.5, np.full(len(final), 0.5 / len(final)))
    p, q = base
    for _ in range(200):
        mine = p * cut
        post = mine / np.maximum(mine + q[:, None] * whole, 1e-300)
        p, q = ((final * post).sum() + weight * base[0]) / (total + weight), ((final * (1 - post)).sum(1) + weight * base[1]) / (total + weight)
    return p, q


def learn_limits(counts: Mapping[tuple[str, str, str, int], int]) -> dict[tuple[str, str], float]:
    """For each (language, class of endings) the score under which an end is likelier cut than complete.

    `counts` are the samples by (language, sample, class, bin). How scores of cut and of complete ends spread comes from
    the held-out ones, with what is known of all languages as the prior of each; how many texts of a language are cut,
    and of which class the complete ones are, from the mixture that explains their own ends. No threshold is set by hand
    and none depends on a language having some number of texts.
    """
    languages, bins = sorted({k[0] for k in counts}), int((HIGH - LOW) / WIDTH) + 1
    tables = {s: np.zeros((len(languages), len(ENDINGS), bins)) for s in ("final", "line", "cut")}
    for (lang, sample, ending, b), n in counts.items():
        tables[sample][languages.index(lang), ENDINGS.index(ending), b] += n

    def smooth(x: np.ndarray) -> np.ndarray:
        wide = np.concatenate([x[..., :1], x, x[..., -1:]], -1)
        return 0.5 * x + 0.25 * (wide[..., :-2] + wide[..., 2:])

    line, cut, final = smooth(tables["line"]), smooth(tables["cut"]), tables["final"]
    flat = np.full(bins, 1 / bins)
    of_all = _spread(line.sum((0, 1)), flat, 1)  # the ends of all lines; then by class, then by language
    of_class = _spread(line.sum(0), of_all, 1)
    every = _spread(cut.sum(0), np.full(cut.shape[1:], 1 / (len(ENDINGS) * bins)), 2)
    base = _mixture(final.sum(0), every, of_class, None)
    out = {}
    for i, lang in enumerate(languages):
        of_cut, whole = _spread(cut[i], every, 2), _spread(line[i], of_class, 1)
        p, q = _mixture(final[i], of_cut, whole, base)
        for k, ending in enumerate(ENDINGS):
            gain = np.r_[0.0, np.cumsum(p * of_cut[k] - q[k] * whole[k])]  # of calling all under an edge cut
            best = int(gain.argmax())
            out[lang, ending] = -np.inf if best == 0 else np.inf if best == bins else LOW + WIDTH * best
    return out


def mark_cut(scores: DataFrame) -> DataFrame:
    """doc_id, source, ending, score, threshold and is_cut of each document's own end.

    A text is cut if its score lies under the threshold learned for its language and class of ending (see learn_limits).
    Only half a character at its end is cut without asking the model; empty texts never are. The counts that reach the
    driver are bounded by the languages' codes, classes and bins.
    """
    spark = scores.sparkSession
    b = F.floor((F.least(F.greatest("score", F.lit(LOW)), F.lit(HIGH)) - LOW) / WIDTH).cast("int")
    known = scores.where(F.col("score").isNotNull() & F.col("ending").isin(*ENDINGS))
    rows = known.groupBy("language", "sample", "ending", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    limits = learn_limits({(r["language"], r["sample"], r["ending"], r["bin"]): r["n"] for r in rows})
    table = spark.createDataFrame([(*k, float(v)) for k, v in limits.items()], "language string, ending string, threshold double")
    final = scores.where("sample = 'final'").join(F.broadcast(table), ["language", "ending"], "left")  # bounded as above
    cut = F.when(F.col("score").isNull(), False).when(F.col("ending") == "broken", True).otherwise(F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)))
    return final.select("doc_id", "source", "language", "ending", "score", "threshold", cut.alias("is_cut"))


def cut_documents(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id of the documents whose text breaks off before its end. Null, empty and blank texts are none. Repeated
    doc_ids are judged each by their own text. Thresholds are of the column given."""
    return mark_cut(ending_scores(documents, column)).where("is_cut").select("doc_id")


def cut_share(documents: DataFrame, column: str = "text") -> DataFrame:
    """source, documents, cut and cut_share: how often each source truncates. A null source is one of its own."""
    marked = mark_cut(ending_scores(documents, column))
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("is_cut").cast("long")).alias("cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"))

"""Cut texts: held-out accuracy on a corpus that is cut here, and the parts of the check."""

import random

import pytest

from sensorframe.llm import truncation as C

WORDS = "river castle village museum narrow ancient northern public railway bridge harbour festival regiment dialect".split()
NAMES = [a + b for a in ("Tor", "Mel", "Gal", "Osh", "Pel", "Ran") for b in ("mor", "fer", "wen", "dun", "lin")]


def article(r):
    lines = []
    for _ in range(r.randrange(2, 6)):
        s = [f"The {r.choice(WORDS)} {r.choice(WORDS)} of {r.choice(NAMES)} was closed in {r.randrange(1100, 2000)}.", f"[[{r.choice(NAMES)}]] lies about {r.randrange(99)} kilometres from the {r.choice(WORDS)} {r.choice(WORDS)}.", f'It is known for "{r.choice(WORDS)}".<ref name="{r.choice(NAMES)}">{r.choice(NAMES)} {r.choice(WORDS)}, p. {r.randrange(99)}.</ref>']
        lines.append(" ".join(r.choice(s) for _ in range(r.randrange(2, 7))))
    if r.random() < 0.4:
        lines += [f"* [[{r.choice(NAMES)}]], {r.choice(WORDS)} {r.choice(WORDS)} ({r.randrange(1100, 2000)})" for _ in range(4)]
    lines += [f"[[Category:{r.choice(WORDS)} {r.choice(NAMES)}]]" for _ in range(r.randrange(0, 3))]
    return "\n".join(lines)


def corpus(n, seed):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t, source = article(r), r.choice(["clean", "limit", "broken"])
        if source != "clean" and r.random() < 0.3:
            k = r.randrange(20, len(t) - 3)
            if t[k - 1] not in " .\n]>)\"" and t[k] not in "\n.":
                t = t[:k] + r.choice(["", "", "…", " ..."])
                cut.add(i)
        rows.append((i, t, r.choice(["en", "EN ", "en-x", None]), source, len(t), "x"))
    return rows, cut


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, odds string"


def test_accuracy(spark):
    rows, cut = corpus(3000, 1)
    odd = [(10_000, None, None, None, 0, ""), (10_001, "", "en", "clean", 0, ""), (10_002, " \n\t", "en", "clean", 3, ""), (10_003, "…", "en", "clean", 1, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    found = [r.doc_id for r in C.cut_documents(df).collect()]
    assert len(found) == len(set(found))
    hit = len(cut & set(found))
    assert hit / len(found) > 0.97 and hit / len(cut) > 0.93
    share = {r.source: r for r in C.cut_share(df).collect()}
    assert share["clean"].cut_share < 0.01 and share["limit"].cut_share > 0.15 and share[None].documents == 1
    assert sum(r.cut for r in share.values()) == len(found)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.cut_documents(df).collect() == [] and C.cut_share(df).collect() == []


def test_very_long_text(spark, monkeypatch):
    rows, _ = corpus(400, 2)
    long = "\n".join(r[1] for r in rows if r[3] == "clean") * 20
    df = spark.createDataFrame(rows + [(9000, long + " The narrow bri", "en", "limit", 1, ""), (9001, long, "en", "clean", 1, "")], SCHEMA)
    found = {r.doc_id for r in C.cut_documents(df).collect()}
    assert 9000 in found and 9001 not in found


@pytest.mark.parametrize("other", [("bb", 60, -12, 6), ("cc", 4000, -25, -15)])
def test_thresholds_are_learned(other):
    """A language with few texts, and one whose complete ends score as low as cut ones elsewhere."""
    counts = {}

    def add(lang, sample, ending, at, n):
        for k in range(-3, 4):
            counts[lang, sample, ending, int((at + k - C.LOW) / C.WIDTH)] = max(n * (4 - abs(k)) // 16, 1)

    for lang, n, low, high in (("aa", 4000, -12, 6), other):
        for sample, ending, at, m in (("line", "plain", high, n), ("cut", "plain", low, n), ("final", "plain", high, n), ("final", "plain", low, n // 20), ("line", "whole", high, n), ("final", "whole", high, n)):
            add(lang, sample, ending, at, m)
    limits = C.learn_limits(counts)
    assert all(low < limits[lang, "plain"] < high for lang, _, low, high in (("aa", 0, -12, 6), other))
    assert limits["aa", "whole"] < 0 and C.learn_limits({}) == {}


def test_filter_leaves_out_no_wanted_context(spark):
    rows, _ = corpus(40, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = C.ending_scores(df).select("doc_id")  # runs with the filter
    assert wanted.count() > 40
    samples = spark.createDataFrame([(C.final_context(C.bare_end(r[1])),) for r in rows], "context string")
    every = {r.key: (r.n, r.e, r.w) for r in C.count_contexts(df).collect()}
    some = {r.key: (r.n, r.e, r.w) for r in C.count_contexts(df, samples).collect()}
    keys = {c[0][7 - n :] for c in samples.collect() for n in range(1, 8)}
    assert keys <= some.keys() and all(every[k] == v for k, v in some.items()) and len(some) < len(every) / 5


def test_rare_characters_count_like_common_ones(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    r = random.Random(3)
    text = "".join(r.choice("abcdefgh \n古い駅\U0001f600") for _ in range(2000))

    def counts():
        total = Counter()
        for b in C._count(iter([pa.RecordBatch.from_pydict({"text": [text]})])):
            for k, *x in zip(*(c.to_pylist() for c in b.columns)):
                for name, v in zip("new", x):
                    total[k, name] += v
        return total

    every = counts()
    monkeypatch.setattr(C, "COMMON", 5)
    assert counts() == every


def test_lines_that_end_something():
    assert C.line_before("a b\n== c ==") == "a b" and C.line_before("a b\n[[Category:x]]") == "a b" and C.line_before("a b\n\nmore") == "a b"
    assert C.line_before("a b\nmore words.") == "" and C.line_before("a") == "" and C.line_before("a b\n[[x]] more.") == ""


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("See the [[narrow bri", "inside"), ("a {{cite book |title=x", "open"), ('x.<ref name="a', "inside"), ("x <ref>note, p.", "inside"), ("see p.&nb", "inside"), ("== Histo", "inside"), ("{| class=x\n|-\n| [[a]] || b", "open"),
        ("Half a character �", "broken"), ("It was closed.", "whole"), ('It was "closed".', "whole"), ("古い駅。", "whole"), ("यह पुराना है।", "whole"), ("[[Category:mill Tor]]", "whole"), ("#REDIRECT [[Mel]]", "whole"), ("{{stub}}", "whole"), ("|}", "whole"), ("== Notes ==", "whole"),
        ("x.</ref>", "whole"), ("* a Tor\n* b Mel", "same"), ("* [[Tor]]\n* Mel", "same"), ("* [[Tor]], old mill (1200)\n* [[Mel]], ol", "other"), ("It is known for its nar", "plain"), ("[Category:stub]]", "whole"),
    ],
)
def test_ending_class(text, kind):
    assert C.ending_class(text) == kind


def test_bare_end():
    assert C.bare_end("abc … \n") == "abc" and C.bare_end("abc&hellip;") == "abc" and C.bare_end(" ... ") == "" and C.bare_end("a" + " " * 200_000 + "b") == "a" + " " * 200_000 + "b"


def exact_odds(texts):
    """Odds of each text, by plain counting of characters."""
    import math
    import re
    from collections import Counter

    def key(t, i, n):
        """The context of n characters that ends at t[i]."""
        line = t.rfind("\n", 0, i) + 1
        kind = next((k + 1 for k, chars in enumerate(C.KINDS) if t[line] in chars), 0)
        return ("\n" * n + t[: i + 1])[-n:], kind

    plain = lambda t: re.sub("[0-9]+", "0", t).replace("\r", "")
    times, ends = Counter(), Counter()
    for text in texts:
        t = plain(C.bare_end(text)) + "\n"
        for i in range(len(t) - 1):
            if t[i] not in "\t\n \xa0":
                for n in range(1, C.ORDER + 1):
                    times[key(t, i, n)] += 1
                    ends[key(t, i, n)] += t[i + 1] == "\n"

    def odds(t):
        if not t:
            return math.inf
        t, p, q = plain(t), C.START, 1 - C.START
        for n in range(1, C.ORDER + 1):
            a = max(times[key(t, len(t) - 1, n)] - 1, 0)
            e = min(max(ends[key(t, len(t) - 1, n)] - 1, 0), a)
            p, q = (e + C.SMOOTH * p) / (a + C.SMOOTH), (a - e + C.SMOOTH * q) / (a + C.SMOOTH)
        return math.log(p) - math.log(q)

    bare = [C.bare_end(t) for t in texts]
    return [odds(t) for t in bare]


def test_odds_are_those_of_exact_counts(spark):
    texts = [r[1] for r in corpus(40, 6)[0]] + ["See narrowly for it.", "See narrowly again.", "See narrowly"] + ["See brightly\nSee brightly"] * 30
    texts += ["1234567890123456789012345678901234567890\nabc", "x\r\n* y\r12\x0034", "a\x00\nb\x00", "\U0001f600 古い駅\n|cell 1", "| a\n\n\r= b =", "z"]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.odds for r in C.ending_scores(df).where("sample = 'final'").collect()}
    for i, want in enumerate(exact_odds(texts)):
        assert got[i] is None if want == float("inf") else got[i] == pytest.approx(want, abs=1e-6), texts[i]


def test_long_texts_count_like_short_ones(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    r = random.Random(7)
    text = "".join(r.choice(["ab", "12", "345678901234", "\n", "\n* ", " ", "\r\n", "|x"]) for _ in range(3000))

    def counts():
        total = Counter()
        for b in C._count(iter([pa.RecordBatch.from_pydict({"text": [text, None, "", "q"]})])):
            for k, n, e, w in zip(*(c.to_pylist() for c in b.columns)):
                total[k, "n"] += n
                total[k, "e"] += e
                total[k, "w"] += w
        return total

    whole = counts()
    monkeypatch.setattr(C, "SPAN", 50)
    assert counts() == whole


def test_list_items_of_one_shape_that_break_off(spark):
    r = random.Random(8)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(300)]
    rows, cut = [(i, *x[1:]) for i, x in enumerate(corpus(300, 9)[0])], set()
    for i in range(1000, 1400):
        t = "\n".join(f"* [[{r.choice(NAMES)}]], {r.choice(words)}" for _ in range(4))
        if i < 1060:
            t = t[: -r.randrange(2, 6)]
            cut.add(i)
        assert C.ending_class(t) == "same"
        rows.append((i, t, "en", "limit", 0, ""))
    found = {r.doc_id for r in C.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id >= 1000}
    assert len(found & cut) > 0.8 * len(cut) and len(found - cut) < 12

"""The numbered operators against brute force, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm.ann import ScoreAwareQuantizer, nearest, packed, scanned
from latticework.llm.bpe import bpe_digests, bpe_ids
from latticework.llm.common import documents
from latticework.llm.jaccard_join import best_links, cell_pairs, first_of_classes, jaccard_classes, needed, packed_counts, unpacked_counts
from latticework.llm.packing import pack_documents, plan
from latticework.llm.pii import pii_spans, sanitise
from latticework.llm.quality_model import good_documents, quality
from latticework.llm.quality_rules import line_rules
from latticework.llm.suffix_dedup import remove_repeats, repeat_digests
from latticework.llm.token_counts import token_counts
from latticework.llm.toxicity import FactorizationMachine, learn_toxicity, terms, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "two  blanks and a tail ", "tabs\tand\r\nlines\n\n  end", "don't we'll ''s", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>z", "é é 漢字 🎉🎉", "\x1c\x85 　 x", "123 45 6a",
    "word " * 3000, "x" * 4000, "The same text here.", "The same text here.", "\x00\x01",
]
CLASH = "doc_id long, text string, lang string, n_tokens long, score double, node long, _doc long, _id long, _place long, _bucket long, _tag long, _text long, sequence_id string, `a b` string"


def frame(spark, rows):
    """Rows (doc_id, text) with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 0.5, 7, 9, 9, 9, 9, 9, 9, "s", "x") for i, t in rows], CLASH)


def odd_rows():
    return [*enumerate(ODD), (100, None), (None, "no id at all"), (3, ODD[3]), (5, "another text of five")]


def test_token_counts(spark):
    tok = Tokenizer.from_file(WORDS)
    got = token_counts(frame(spark, odd_rows()), WORDS, limit=100).collect()
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows()]
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == collections.Counter(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts(frame(spark, []), WORDS).count() == 0


def test_bpe(spark):
    tok = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in odd_rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert collections.Counter(map(tuple, bpe_digests(frame(spark, odd_rows()), BYTES).collect())) == collections.Counter(want)
    assert bpe_ids(frame(spark, [(1, "a b")]), BYTES).first().ids == tok.encode("a b").ids
    assert bpe_digests(frame(spark, []), BYTES).count() == 0


def test_packing(spark):
    tok = Tokenizer.from_file(BYTES)
    rows = odd_rows()
    got = pack_documents(frame(spark, rows), BYTES).collect()
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in texts.values() for x in v)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    assert pack_documents(frame(spark, []), BYTES).count() == 0


def test_only_long_documents_are_cut(spark):
    """Documents of more than 1024 ids come in pieces of 1024, the first of which has the rest; others whole."""
    tok = Tokenizer.from_file(BYTES)
    rows = [(i, "word " * n) for i, n in enumerate((0, 1, 500, 1022, 1023, 1024, 2046, 2047, 2048, 5000))] + [(20, "x y" * 40_000)]
    got = collections.defaultdict(list)
    for r in sorted(pack_documents(frame(spark, rows), BYTES).collect(), key=lambda r: r.piece):
        got[r.doc_id].append((r.piece, r.start, r.length))
    for i, t in rows:
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        sizes = [n] if n <= 1024 else [*([n % 1024] if n % 1024 else []), *[1024] * (n // 1024)]
        assert got[i] == [(k, sum(sizes[:k]), x) for k, x in enumerate(sizes)]


def test_plan_is_close_to_the_bound():
    histogram = np.bincount(np.random.default_rng(0).integers(1, 1025, 20000), minlength=1025)
    rows = plan(histogram, 1024)
    given = np.bincount(rows[:, 0], rows[:, 2], 1025)
    assert (given == histogram).all()
    sequences = int((rows[:, 3] + rows[:, 2]).max())
    assert sequences <= 1.005 * -(-int((histogram * np.arange(1025)).sum()) // 1024)


def brute_rules(t):
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base


def test_line_rules(spark):
    good = "This is a fine line of plain words that ends well.\nAnd here is another line, just as fine as the first."
    rows = [*odd_rows(), (200, good), (201, good + "\nHome | News | About\nHome | Login | Help | Shop"), (202, "a | b | c | d\ne | f | g | h\ni | j | k | l"), (203, good + "\n" + good)]
    got = line_rules(frame(spark, rows)).collect()
    key = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert collections.Counter(map(key, got)) == collections.Counter((i, *brute_rules(t or "")) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[200].kept and by[201].kept and by[201].cleaned == good and not by[202].kept and not any(r.kept for r in got if r.base_failed)
    assert line_rules(frame(spark, [])).count() == 0


def test_cleaned_keeps_repeats_and_blanks(spark):
    """Only failed lines leave a text: a good line stays as often as it comes, blank ones too."""
    good, bad = "A good line of more than four words ends here.", "Home | News | Sport | About"
    rows = [(203, good + "\n" + good), (1, f"{good}\n\n{bad}\n \n{good}\nAnother good line of some words, at last.\n{bad}\n{good}\n"), (2, f"{bad}\n\n{bad}"), (3, "\n \n"), (4, None)]
    got = {r.doc_id: r for r in line_rules(frame(spark, rows)).collect()}
    assert got[203].cleaned == rows[0][1] and got[203].n_lines_failed == 0
    assert got[1].cleaned == f"{good}\n\n \n{good}\nAnother good line of some words, at last.\n{good}\n" and (got[1].n_lines, got[1].n_lines_failed, got[1].chars_lost, got[1].n_dup_lines) == (6, 2, 2 * len(bad), 3)
    assert got[2].cleaned == got[3].cleaned == got[4].cleaned == ""


def test_line_rules_of_long_texts(spark):
    """A hundred thousand lines, a third of them alike, and half a million words of a few kinds, in seconds."""
    lines = [f"Line number {i} of a long text ends here." if i % 3 else "A line that comes again and again, all through." for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, " ".join(f"w{i % 7}" for i in range(100_000)))]
    began = time.time()
    got = {r.doc_id: r for r in line_rules(frame(spark, rows)).collect()}
    assert time.time() - began < 60
    want = brute_rules(rows[0][1])
    assert got[1].cleaned == rows[0][1] and (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words, got[1].base_failed) == want and got[2].n_repeat_words == 100_000


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw, spans = t.encode(), []
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
            seen.add(raw[p : p + length])
        e = [0, *(x for s in spans for x in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(e[::2], e[1::2]))
        out[i] = (len(raw), len(raw) - len(kept), len(spans), kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    g = random.Random(seed)
    line = "".join(g.choice("abcdefgh ") for _ in range(70))
    passage = "".join(g.choice("abcdefghé ") for _ in range(150))
    rows = [(0, ""), (1, "ab" * 200), (2, "ab" * 130 + "c"), (3, passage), (4, "x" + passage[20:] + "y"), (5, passage * 2), (6, "short")]
    for i in range(7, 40):
        rows.append((i, "".join(g.choice([line, passage, passage[:g.randrange(1, 150)], passage[g.randrange(150):], "".join(g.choice("abc") for _ in range(30))]) for _ in range(g.randrange(1, 6)))))
    want = brute_repeats(rows, 100)
    got = remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert set(CLASH.replace("`", "").split(", ")[0].split()[:1]) <= set(got[0].asDict())


def test_repeats_of_odd_rows(spark):
    rows = odd_rows()
    got = repeat_digests(frame(spark, [*rows, (None, "no id at all")])).collect()
    assert len(got) == len(rows) + 1
    assert {r.n_removed for r in got if r.doc_id == 100} == {0}
    assert repeat_digests(frame(spark, [])).count() == 0


def test_repeated_rows_are_one_document(spark):
    """Rows equal in id and text lose only what starts earlier in them or in others, not each other's text."""
    g = random.Random(7)
    long, twice, other = ("".join(g.choice("abcdefgh ") for _ in range(n)) for n in (900, 300, 400))
    once = [(1, long), (2, twice + " - " + twice), (3, other + long), (None, other)]
    got = remove_repeats(frame(spark, [*once, *once, (4, long)]).repartition(3)).collect()
    want = brute_repeats([(-1 if i is None else i, t) for i, t in [*once, (4, long)]], 100)
    assert len(got) == 9 and all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == tuple(want[-1 if r.doc_id is None else r.doc_id]) for r in got)
    assert {r.n_removed for r in got if r.doc_id in (1, None)} == {0}


@pytest.mark.parametrize("length", [8, 24, 100, 1500])
def test_repeats_of_other_lengths(spark, length):
    g = random.Random(length)
    passage = "".join(g.choice("abcdefghé ") for _ in range(2 * length))
    rows = [(i, "".join(g.choice([passage, passage[: length + 3], passage[length // 2 :], "".join(g.choice("abcxyz") for _ in range(length))]) for _ in range(3))) for i in range(12)]
    got = remove_repeats(frame(spark, rows), length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_repeats(rows, length)
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, rows), 5000 if length > 100 else 7)


def test_repeats_beyond_a_segment(spark):
    """Texts of several segments, with a repeat across a cut and far apart; columns of names that the operator uses keep their values."""
    g = np.random.default_rng(4)
    long = bytes(g.integers(97, 123, 1_600_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, long[690_000:710_000] + "-" + long[1_399_000:1_500_000]), (3, "tail " + long[5:140])]
    docs = frame(spark, rows).withColumn("kept", F.lit("own")).withColumn("n_bytes", F.lit(-1))
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert [(got[i].n_bytes_, got[i].n_removed, got[i].n_spans, bytes(got[i].kept_)) for i in (1, 2, 3)] == [(1_600_000, 0, 0, long.encode()), (121_001, 121_000, 2, b"-"), (140, 135, 1, b"tail ")]
    assert all((r.kept, r.n_bytes, r._doc, r._tag, r._text, r._bucket, r.score) == ("own", -1, 9, 9, 9, 9, 0.5) for r in got.values())


def test_kept_columns_that_clash(spark):
    """Values of columns whose names the operators use come back as they went in."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "write to x@y.org now"), (None, "no id")]
    for out in (first_of_classes(frame(spark, rows)), sanitise(frame(spark, rows))):
        got = out.collect()
        assert out.columns == frame(spark, rows).columns and all((r._id, r._place, r._bucket, r._tag, r._doc, r.node, r.sequence_id) == (9, 9, 9, 9, 9, 7, "s") for r in got)


def luhn(s):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(s)))) % 10 == 0


def brute_spans(t):
    found = []
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for n, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()  # noqa: B023
            if ok:
                found.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_personal_data(spark):
    texts = [
        "a@b.c@d.e x@y a.b@c.d.e.f_g@h.i", "1.2.3.4.5.6.7.8 001.2.3.4 999.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111, 41111111111111111111111111", "+1 (555) 123-4567. +12 3 +49 30 1234567890 12",
        "é 4111111111111111 日本 a@b.co", ".@a.b a..b@c.d-e.f", "x" * 3000 + "@" + "y" * 100 + ".z", "1" * 30000, "1-" * 8000 + "1", "@@a@b.c", "a@b.c._%a@d.e", "+1" * 50 + " +123456789012", "0000000000.0.0.0 ",
    ]
    rows = [*odd_rows(), *enumerate(texts, 300)]
    got = pii_spans(frame(spark, rows)).collect()
    want = collections.Counter((i, hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii_spans(frame(spark, [])).count() == 0


def test_spans_of_long_texts(spark):
    """Twenty thousand addresses in one text, in seconds, with their places and cut out."""
    text = "é " + " and ".join(f"10.{i % 250}.{i // 250}.7" for i in range(20_000)) + " 🎉 x@y.z"
    began = time.time()
    got = pii_spans(frame(spark, [(1, text)])).first()
    out = sanitise(frame(spark, [(1, text)])).first().text
    assert time.time() - began < 90
    assert got.n_ip == 20_000 and got.spans == brute_spans(text) and out == "é " + " and ".join(["[IP]"] * 20_000) + " 🎉 [EMAIL]"


def test_spans_that_overlap_are_cut_as_one(spark):
    text = "call +378282246310005 or 4111 1111 1111 1111"  # the first is a card number too
    assert sanitise(frame(spark, [(1, text)])).first().text == "call [PHONE] or [CARD]"


def brute_terms(rows, least_share=0.95, least_documents=3):
    """Places of the terms of each row, counting values and terms in whole texts."""
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    values = [{m[0].lower() for m in mail.finditer(t)} for _, t in rows]
    words = [{w.lower() for w in regex.findall(r"\p{L}+", t)} for _, t in rows]
    n_value, n_term, n_both = collections.Counter(), collections.Counter(), collections.Counter()
    for v, w in zip(values, words, strict=True):
        n_value.update(v)
        n_term.update(w)
        n_both.update((a, b) for a in v for b in w)
    n, out = len(rows), {}
    told = {(a, b) for (a, b), k in n_both.items() if k >= least_documents and n_value[a] < n and math.log(n * k / (n_value[a] * n_term[b])) / math.log(n / n_value[a]) >= least_share}
    for (i, t), v, w in zip(rows, values, words, strict=True):
        marked, base = {b for a in v for b in w if (a, b) in told}, [m.span() for m in mail.finditer(t)]
        out[i] = {f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"\p{L}+", t) if m[0].lower() in marked and not any(a < m.end() and m.start() < b for a, b in base)}
    return out


def test_terms_against_brute_force(spark):
    g = random.Random(11)
    names, common = [f"name{c}" for c in "abcdefgh"], ["often", "seen", "words", "here", "Ünd", "there"]
    rows = []
    for i in range(120):
        k = g.randrange(8)
        own, mail = [g.choice(common) for _ in range(12)], g.random() < 0.6
        own += [names[k], names[k].upper(), f"x{k}@mail.org"] if mail else [names[k]] * (k < 4)  # the first names stand alone as well
        own += [f"x{(k + 1) % 8}@mail.org"] * (g.random() < 0.1)
        g.shuffle(own)
        rows.append((i, " ".join(own)))
    got = {r.doc_id: {x for x in r.spans.split(",") if x.startswith("term")} for r in pii_spans(frame(spark, rows)).collect()}
    want = brute_terms(rows)
    assert got == want and sum(map(len, want.values())) > 20


def test_terms_of_the_given_documents(spark):
    """Terms that reveal kinds, domains or first digits, over the whole table, against counts in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii_spans(docs, classes=True).collect()}
    n_value, n_term, n_both, held = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        values = set()
        for kind, a, b in spans[i]:
            if kind == "term":
                continue
            m, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            part = {"email": m.rpartition("@")[2], "ip": ".".join(m.split(".")[:2]), "card": digits[:4], "phone": digits[:3]}[kind]
            values |= {f"{kind}:{m}", f"{kind}*{part}", f"{kind}*"}
        held[i] = values, {w.lower() for w in regex.findall(r"\p{L}+", t)}
        n_value.update(values)
        n_term.update(held[i][1])
        n_both.update((a, b) for a in values for b in held[i][1])
    n = len(rows)
    told = {(a, b) for (a, b), k in n_both.items() if k >= 3 and n_value[a] < n and math.log(n * k / (n_value[a] * n_term[b])) / math.log(n / n_value[a]) >= 0.95}
    found = 0
    for i, t in rows:
        values, words = held[i]
        marked, base = {b for a in values for b in words if (a, b) in told}, [s for s in spans[i] if s[0] != "term"]
        want = {(m.start(), m.end()) for m in regex.finditer(r"\p{L}+", t) if m[0].lower() in marked and not any(a < m.end() and m.start() < b for _, a, b in base)}
        assert {(a, b) for k, a, b in spans[i] if k == "term"} == want
        found += len(want)
    assert found > 0


def test_revealing_terms(spark):
    """A term found with one address only, in three documents, reveals it; one found elsewhere too doesn't."""
    rows = [(i, f"Please write to zorblat common anna@x.org about item {i}.") for i in range(3)] + [(i, f"Something common about nothing {i}.") for i in range(3, 30)]
    got = {r.doc_id: r.spans for r in pii_spans(frame(spark, rows)).collect()}
    assert got[0].startswith("term:0:6,term:7:12") and "term:16:23" in got[0] and "email:31:41" in got[0] and "term:24:30" not in got[0]
    assert got[5] == ""
    texts = {r.doc_id: r.text for r in sanitise(frame(spark, [*rows, (77, None)])).collect()}
    assert "[EMAIL]" in texts[0] and "zorblat" not in texts[0] and "common" in texts[0] and texts[5] == rows[5][1] and texts[77] is None


def test_terms_reveal_over_whole_texts(spark):
    """A term tells of a value of its text from any distance, at any length, wherever it stands."""
    far, mail = "common words in between " * 20, "anna@x.org"
    rows = [(i, f"Zorblat {far}{mail} {far}zorblat, ZORBLAT; 🎉 Li {far}zorblats 李明。Anna") for i in range(3)]
    rows += [(None, rows[0][1]), (0, rows[0][1])] + [(i, f"common words in between about {i}, no other@y.org") for i in range(3, 30)] + [(40, "Nobody alone"), (41, "")]
    got = pii_spans(frame(spark, rows)).collect()
    found = {r.doc_id: r.spans for r in got}
    text = rows[0][1]
    told = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)\b(zorblats?|li|李明|anna)\b(?!@)", text)]
    at = text.index(mail)
    want = sorted([*told, f"email:{at}:{at + len(mail)}"], key=lambda x: int(x.split(":")[1]))
    assert len(told) == 7 and len(got) == len(rows) and all(found[i] == ",".join(want) for i in (0, 1, 2, None)) and found[40] == found[41] == ""
    texts = [r.text for r in sanitise(frame(spark, rows)).collect() if r.doc_id in (0, 1, 2, None)]
    assert len(texts) == 5 and all("zorblat" not in t.lower() and "Li" not in t and "李明" not in t and t.count("common words") == 60 for t in texts)


def brute_classes(rows, width, percent):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets, up = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_classes(spark, width, percent):
    g = random.Random(width)
    words = [f"w{k}" for k in range(400)]
    base = [[g.choice(words) for _ in range(60)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One two"), (4, "one  TWO"), (5, "one two three")]
    for i in range(6, 90):  # chains of small changes, so that classes hold texts that aren't alike themselves
        k = g.randrange(6)
        text = list(base[k])
        for _ in range(g.randrange(3)):
            text[g.randrange(60)] = g.choice(words)
        if g.random() < 0.3:
            base[k] = text
        rows.append((i, " ".join(text)))
    got = jaccard_classes(frame(spark, [*rows, (50, dict(rows)[50]), (None, "one two")]), width, percent).collect()
    want = brute_classes(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = [r.doc_id for r in first_of_classes(frame(spark, rows), width, percent).collect()]
    assert sorted(kept) == sorted(i for i, (n, c) in want.items() if c == i)
    assert jaccard_classes(frame(spark, []), width, percent).count() == 0


def brute_pairs(n, point, comp, side, percent):
    """Pairs by summed smaller counts; points with more groups are folded to the other's."""
    out = set()
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            x, y = sorted((point[i], point[j]), key=len)
            over = int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())
            if comp[i] != comp[j] and (side.max() == 0 or side[i] != side[j]) and over >= needed(n[i], n[j], percent):
                out.add((i, j, over))
    return out


@pytest.mark.parametrize("sides", [1, 2])
def test_trees_miss_nothing(sides):
    g = np.random.default_rng(sides)
    base = g.poisson(6, (8, 64)) + (g.random((8, 64)) < 0.02) * 70_000  # some counts are beyond 16 bits
    point = [p.astype(np.int64) for p in np.maximum(0, base[g.integers(0, 8, 300)] + g.integers(-1, 2, (300, 64)) * (g.random((300, 64)) < 0.1))]
    point = [p.reshape(32, 2).sum(1) if g.random() < 0.3 else p for p in point]
    n, comp, side = np.array([p.sum() for p in point]), g.integers(0, 40, 300), g.integers(0, sides, 300)
    raw = [packed_counts(p) for p in point]
    assert all((unpacked_counts(r) == p).all() for r, p in zip(raw, point, strict=True)) and {r[0] for r in raw} == {1, 4}
    i, j, over = cell_pairs(n, raw, comp, side, 85)
    assert {(min(a, b), max(a, b), c) for a, b, c in zip(i.tolist(), j.tolist(), over.tolist(), strict=True)} == brute_pairs(n, point, comp, side, 85)
    best = {int(k) for k in best_links(i, j, over, 300)}
    for k in np.unique(np.concatenate([i, j])):  # each point's best pair is among them
        own = np.flatnonzero((i == k) | (j == k))
        assert any(int(o) in best and over[o] == over[own].max() for o in own)


@pytest.mark.parametrize("long_side", [0, 1])
def test_groups_on_one_side_alone(long_side):
    """Two blocks of which one alone has points of more groups."""
    g = np.random.default_rng(5)
    point = [g.poisson(0.1, 512).astype(np.int64) for _ in range(12)]
    point += [p + (g.random(512) < 0.005) for p in point[:6]] + [g.poisson(0.1, 2048).astype(np.int64) for _ in range(2)]
    n, side = np.array([p.sum() for p in point]), np.array([0] * 12 + [1] * 6 + [long_side] * 2)
    i, j, over = cell_pairs(n, [packed_counts(p) for p in point], np.arange(20), side, 85)
    found = {(min(a, b), max(a, b), c) for a, b, c in zip(i.tolist(), j.tolist(), over.tolist(), strict=True)}
    assert len(found) >= 6 and found == brute_pairs(n, point, np.arange(20), side, 85)


def test_a_cell_of_many_blocks(spark):
    """A group of near copies larger than several blocks, texts that share most of it below the limit, and long texts."""
    g = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    base = [g.choice(words) for _ in range(80)]
    rows = []
    for i in range(1300):
        text = list(base)
        text[g.randrange(80)] = f"own{i}"
        if i % 10 == 0:  # too far from the others
            text[20:60] = [g.choice(words) for _ in range(40)]
        rows.append((i, " ".join(text)))
    long = [g.choice(words) for _ in range(60_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join([*long[:30_000], "else", *long[30_001:]])), (2002, " ".join(long[:45_000]))]
    got = {r.doc_id: r.component_id for r in jaccard_classes(frame(spark, rows), 4, 85).collect()}
    near = [i for i in range(1300) if i % 10]
    assert {got[i] for i in near} == {1} and all(got[i] == i for i in range(0, 1300, 10)) and (got[2000], got[2001], got[2002]) == (2000, 2000, 2002)


def test_nearest(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(400, 16)).astype(np.float32)
    v[50:90] = v[40]  # many equal vectors
    rows = [(i, x.tolist(), 1.0) for i, x in enumerate(v)] + [(1000, None, 1.0), (1001, [0.0] * 16, 1.0), (1002, [float("nan")] * 16, 1.0), (1003, [1.0, None] * 8, 1.0), (1020, [1.0] * 3, 1.0), (None, [1.0] * 16, 1.0)]
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double"), k=20, every=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    x, hits = v.astype(float), 0
    for q, found in got.items():
        score = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:20]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([f[2] for f in found], [score[f[1]] for f in found])
        hits += len(set(want) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    few = nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_of_nearest(spark, kind):
    """Many cells and blocks, far more rows than are reranked, against brute force."""
    g = np.random.default_rng(8)
    x = g.normal(size=(20_000, 32)) if kind == "even" else g.normal(size=(60, 32))[g.integers(0, 60, 20_000)] + 0.3 * g.normal(size=(20_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    got = collections.defaultdict(dict)
    for r in nearest(spark.createDataFrame(table), k=20, every=100, cell=1000, block_rows=700, block_queries=60).collect():
        got[r.query_id][r.vec_id] = r.score
    assert len(got) == 200
    x, hits = x.astype(float), 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(found))
        assert len(found) == 20 and np.allclose([score[i] for i in found], list(found.values()))
    assert hits >= 0.95 * 20 * len(got), hits / 4000


def test_four_bit_scan():
    """Byte tables give what adding up the parts' entries gives, but for rounding; best rows first."""
    g = np.random.default_rng(2)
    x, q = g.normal(size=(500, 15)), g.normal(size=(20, 15))
    quantizer = ScoreAwareQuantizer(15)
    quantizer.fit(x)
    codes = quantizer.encode(x)
    plain = quantizer.tables(q)[:, np.arange(quantizer.parts), codes].sum(2)
    rough = scanned(quantizer.byte_tables(q), packed(codes)).astype(float)
    assert codes.max() < 16 and packed(codes).shape == (500, 4)
    assert all(np.corrcoef(a, b)[0, 1] > 0.999 for a, b in zip(plain, rough, strict=True))


def labelled(spark, g, bad):
    words = ["thon", "erin", "ouwh", "stly", "andea", "tion", "hered", "inble"]
    rows, labels = [], []
    for i in range(300):
        text = [g.choice(words) for _ in range(40)]
        wrong = i % 3 == 0
        rows.append((i, bad(text, g) if wrong else " ".join(text) + "."))
        labels.append((i, int(not wrong), int(wrong)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    g = random.Random(1)
    rows, labels = labelled(spark, g, lambda t, g: " ".join([*t[:20], g.choice(["moronic", "idiot", "scum"]), *t[20:]]))
    got = toxicity(frame(spark, [*rows, (900, None), (901, ""), (None, "idiot")]), labels).collect()
    test = [r for r in got if r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in test) >= 0.97 * len(test) and all(0 <= r.score <= 1 for r in got) and len(got) == 303
    assert toxicity(frame(spark, []), labels).count() == 0
    assert toxicity(frame(spark, rows[:5]), labels.limit(0)).count() == 5


def test_machine_learns_pairs():
    """Neither feature tells alone; both together do."""
    g = np.random.default_rng(0)
    has = g.random((400, 2)) < 0.5
    row, feature = np.nonzero(has)
    label = (has[:, 0] & has[:, 1]).astype(float)
    machine = FactorizationMachine(2)
    machine.fit(feature, row, label)
    assert (((machine.logits(feature, row, 400) > 0) == (label > 0)).mean()) == 1.0


def test_toxicity_of_pairs_alone(spark):
    """Neither of two words tells: texts with one of them are as often toxic as those with both or none. The machine tells, an additive one can't."""
    g = random.Random(5)
    plain = ["thon", "erin", "ouwh", "stly", "andea", "tion", "hered", "inble"]
    rows, labels = [], []
    for i in range(1200):
        first, second = i % 2, i // 2 % 2
        text = [g.choice(plain) for _ in range(30)] + ["zorblat"] * first + ["quimby"] * second
        g.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(first == second)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    test = [r for r in toxicity(frame(spark, rows), table).collect() if r.held_out]
    want = {i: t for i, _, t in labels}
    assert sum((r.score >= 0.5) == (want[r.doc_id] == 1) for r in test) >= 0.95 * len(test)
    slots, machine = learn_toxicity(documents(frame(spark, rows)), table, factors=0)
    assert machine.v.shape[1] == 0 and abs(machine.w[slots[terms(["zorblat"])[0][0]]]) < 1.5


def test_toxicity_of_real_labels(spark):
    """On the test tables, most held-out toxic rows are caught and few clean ones."""
    top = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{top}/{n}.parquet") for n in ("documents", "labels"))
    want = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in want]
    toxic, clean = [r for r in got if want[r.doc_id]], [r for r in got if not want[r.doc_id]]
    assert len(toxic) >= 10 and sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_quality_on_held_out_rows(spark):
    g = random.Random(2)
    rows, labels = labelled(spark, g, lambda t, g: g.choice([" ".join(w.upper() + "!!" for w in t), " | ".join(t), " ".join([t[0]] * 40)]))
    docs = frame(spark, [*rows, (900, None), (901, "")])
    got = quality(docs, labels).collect()
    test = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in test) >= 0.97 * len(test) and len(got) == 302
    good = {r.doc_id for r in good_documents(docs, labels).collect()}
    assert good == {r.doc_id for r in got if r.predicted}
    assert quality(frame(spark, []), labels).count() == 0

"""Operators on text against brute force, library results and small planted cases; nulls, empty and long texts, ties, empty tables."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.boilerplate import Model, decode, furniture, main_text
from lodestone.llm.leakage import find_leaks, word_offsets
from lodestone.llm.listings import fit_weights, grouped, linked, readings
from lodestone.llm.near_duplicates import similar_pairs, similar_sets
from lodestone.llm.pages import BUCKETS, TOKEN, buckets_of
from lodestone.llm.pii import disclosed, redacted
from lodestone.llm.residue import masked, residue_rows, simhash, spread
from lodestone.llm.spans import shares, tree_spans
from lodestone.llm.tokenizer import VOCABULARY, encode_corpus
from lodestone.llm.truncation import field_limits, judged, tails_of


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# problem 8


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(3)
    characters = [chr(c) for c in range(32, 0x2000)] + list(" '\n\t\r\x1c\x85 ")
    texts = ["", None, "a" * 3000, "<|endoftext|>", "  two  spaces \n\n", "it's I'LL ½ Ⅷ ²"] + ["".join(r.choice(r.choice([characters, " ab1'_"])) for _ in range(60)) for _ in range(200)]
    texts = [t if t is None else "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    for n, t in enumerate(texts):
        assert got[n] == library.encode(t or "", add_special_tokens=False).ids
    assert encode_corpus(spark.createDataFrame([], "doc_id int, text string, ids int")).count() == 0


# problem 9


def test_leaks_equal_brute_force(spark):
    item = " ".join(words(20, 1))
    docs = [(1, "start " + item.upper().replace(" ", ", ") + " end"), (2, " ".join(item.split()[:12])), (3, None), (4, ""), (5, "x " + " ".join(item.split()[3:16]) + " y " + " ".join(item.split()[:13])), (6, item)]
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id int, text string")
    found = find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), items)
    assert rows(found.select("item_id", "doc_id").distinct()) == [(7, 1), (7, 5), (7, 6)]
    spans = {(r.doc_id, r.first_char): r for r in found.collect()}
    assert spans[1, 6].n_words == 20 and docs[0][1][6 : spans[1, 6].end_char] == item.upper().replace(" ", ", ")
    assert [n for d, n in spans if d == 5] and len([1 for d, _ in spans if d == 5]) == 2
    assert word_offsets("İ ab") == [(0, 1), (2, 4)]
    assert find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), items.where("false")).count() == 0


# problem 10


def brute_shares(texts, least):
    seen = defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t or "") - least + 1):
            seen[t[i : i + least]].add(k)
    out = {}
    for k, t in texts.items():
        covered = set()
        for i in range(len(t or "") - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                covered.update(range(i, i + least))
        out[k] = len(covered)
    return out


@pytest.mark.parametrize("most_classes", [256, 1])
def test_shares_equal_brute_force(spark, most_classes):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(500)) for _ in range(4)]
    texts = {n: b for n, b in enumerate(base)}
    texts |= {10: base[0][50:250] + "#" + base[1][:99], 11: "é" + base[2][100:199], 12: base[3][10:130] + base[3][10:130], 13: None, 14: "", 15: base[1], 16: "x" * 400, 17: "y" + "x" * 300, 18: base[0][:149] + "Z" + base[0][150:]}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string").withColumn("t", F.lit(1)).withColumn("h", F.lit("clash"))
    got = {x.doc_id: x.shared_chars for x in shares(df, 100, window=60, max_classes=most_classes).collect()}
    assert got == brute_shares(texts, 100)


def test_tree_spans_extend_to_the_left():
    spans = tree_spans(["ab", "xb"], ["cdefgh", "cdefzz"], [1, 2], [True, True], 5)
    assert spans == [[(-1, 4)], [(-1, 4)]]
    assert tree_spans(["ab", "xb"], ["cdefgh", "cdefzz"], [1, 2], [True, True], 6) == [[], []]


# problem 5


def brute_pairs(records, least_words, shingle, threshold):
    sets = {}
    for i, t in records:
        w = re.findall(r"\w+", (t or "").lower())
        if len(w) >= least_words:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    keys = sorted(sets)
    return {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark):
    r = random.Random(9)
    records = []
    for n in range(30):
        w = words(80, n, 3000)
        records.append((10 * n, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for _ in range(r.randrange(1, 7)):
                v[r.randrange(len(v))] = f"edit{r.randrange(999)}"
            records.append((10 * n + k, " ".join(v)))
    crowd = words(90, 77, 3000)  # more near copies than a small bucket holds
    for k in range(40):
        v = list(crowd)
        v[k] = f"c{k}"
        records.append((1000 + k, " ".join(v)))
    records += [(2000, records[0][1]), (2001, None), (2002, ""), (2003, "short text")]
    df = spark.createDataFrame([("t", i, t) for i, t in records], "tab string, id long, text string")
    got = {(a.id_a, a.id_b) for a in similar_pairs(df, threshold=0.7, shingle=3, least_words=40).collect()}
    want = brute_pairs(records, 40, 3, 0.7)
    assert got <= want and len(got) >= 0.995 * len(want)
    members, similar = similar_sets(df.where("false"))
    assert members.count() == 0 and similar.count() == 0


def test_pairs_of_mostly_common_shingles_are_met(spark):
    r = random.Random(11)
    records = []
    for n in range(40):  # pairs at 0.70 to 0.75, 85% of whose shared shingles twenty records have; in every other group one text is the other and more
        template = words(142, 1000 + n, 50_000)
        for k in range(10):
            mine, own = template + words(25, 100 * n + k, 10**6), [[f"x{r.randrange(10**9)}" for _ in range(m)] for m in ((34, 34) if n % 2 else (0, 70))]
            records += [(20 * n + 2 * k + e, " ".join(mine + own[e])) for e in (0, 1)]
    df = spark.createDataFrame([("t", i, t) for i, t in records], "tab string, id long, text string")
    got = {(a.id_a, a.id_b) for a in similar_pairs(df, threshold=0.7, shingle=3, least_words=40).collect()}
    want = brute_pairs(records, 40, 3, 0.7)
    assert len(want) >= 400 and got <= want and len(got) >= 0.995 * len(want)


# problem 2


def test_redaction(spark):
    people = [(f"r{n}", "fine product, would buy again", f"{a} {b}") for n, (a, b) in enumerate([("Rosa", "Lundoway"), ("Rosa", "Tolissen"), ("Nils", "Lundoway"), ("Nils", "Tolissen")] * 3)]
    cases = [
        ("a", "Mail rosa.l@inbox.example or nils (at) inbox (dot) example, thanks", None), ("b", "Call me on +49 30 23125 392 now. Ticket 800-3998 is open.", ""), ("c", "My SSN 000-83-1417 was read out. Serial 4740-73-9836 on the box.", "TolIssen, NILS"),
        ("d", "The courier went to 41 rue du Juniper, Linderau instead, aisle 4, Park Lane edition.", "Top reviewer"), ("e", "Signed, rosa lundoway", "Dr. Lundoway"), ("f", None, "Rosa L."), (None, "order 12345", None),
    ]
    df = spark.createDataFrame(people + cases, "id string, review_text string, reviewer string").withColumn("key", F.lit(1)).withColumn("value", F.lit("clash"))
    out = {r.id: r for r in redacted(df).collect()}
    assert out["a"].review_text == "Mail [EMAIL] or [EMAIL], thanks" and out["a"].reviewer is None
    assert out["b"].review_text == "Call me on [PHONE] now. Ticket 800-3998 is open." and out["b"].reviewer == ""
    assert out["c"].review_text == "My SSN [ID] was read out. Serial 4740-73-9836 on the box." and out["c"].reviewer == "[NAME]"
    assert out["d"].review_text == "The courier went to [ADDRESS] instead, aisle 4, Park Lane edition." and out["d"].reviewer == "Top reviewer"
    assert out["e"].review_text == "Signed, [NAME]" and out["e"].reviewer == "[NAME]" and out["f"].reviewer == "[NAME]" and out["f"].review_text is None
    assert out["r0"].review_text == "fine product, would buy again"
    assert redacted(df.where("false")).count() == 0
    assert disclosed(df.where("false"))[1].count() == 0


# problems 1, 3, 6


NOUNS = ["kettle", "lamp", "router", "chair", "drill", "camera", "tent", "scale", "fan", "clock"]


def page(n, furniture=True):
    """A page with furniture that recurs in many pages, and the lines of its body."""
    r = random.Random(n)
    body = [f"# {NOUNS[n % 10].title()} {1000 + n} review"] + [" ".join(f"The {r.choice(NOUNS)} was tested for {r.randrange(99)} weeks by {r.choice(NOUNS)} owners and it held its {r.choice(NOUNS)} well." for _ in range(3)) for _ in range(3)] + [f"- Weight: {n} g"]
    if not furniture:
        return "\n\n".join(body), body
    above, below = r.sample(["Home | Shop | Help", "Accept all cookies to continue", "Sign in to your account", "Menu"], 2), r.sample(["Terms | Privacy | Imprint", "All rights reserved", "Share this page", "Back to top"], 2)
    return "\n\n".join([*above, *body, *below]), body


def site(spark, pages=120):
    """(pages, bodies, without) of a small site; captures come without a known body."""
    rows = [("p", n, page(n)[0]) for n in range(pages)] + [("c", n, page(500 + n)[0]) for n in range(20)]
    rows += [("p", 900 + n, f"Home | Shop | Help\n\nError {400 + n}: no such page here\n\nAll rights reserved") for n in range(12)] + [("c", 90, None), ("c", 91, ""), ("c", 92, "  \n "), ("c", 93, "word " * 20_000)]
    bodies = [("p", n, "\n".join(page(n)[1])) for n in range(pages)]
    frame = spark.createDataFrame(rows, "tab string, id long, text string").withColumn("label", F.lit("clash")).withColumn("n", F.lit(1))
    return frame, spark.createDataFrame(bodies, "tab string, id long, body string"), spark.createDataFrame([("p", 900 + n) for n in range(12)], "tab string, id long")


def test_furniture(spark):
    pages, bodies, without = site(spark)
    found = defaultdict(set)
    for r in furniture(pages, bodies, without).collect():
        found[r.tab, r.id].add(r.line_no)
    right = wrong = 0
    for n in range(20):
        text, body = page(500 + n)
        want = {k for k, x in enumerate(text.split("\n")) if x and x not in body}
        right, wrong = right + len(found["c", n] & want), wrong + len(found["c", n] ^ want)
    assert right >= 78 and wrong <= 2 and ("c", 92) not in found and found["c", 93] <= {0}
    assert all(2 not in found["p", 900 + n] for n in range(12))  # a page's error message is no furniture
    main = {r.id: r.main_text for r in main_text(pages, bodies, without).where("tab = 'c'").collect()}
    assert main[3].startswith("#") and "Terms |" not in main[3] and main[90] is None and main[91] == "" and len(main) == 24
    assert furniture(pages.where("false"), bodies, without).count() == 0 and furniture(pages, bodies.where("false"), without.where("false")).count() == 0


def test_decoding_keeps_lists_whole():
    block, run, shape = np.array([0, 0, 0, 0, 1]), np.array([0, 0, 0, 0, 1]), np.array([1, 1, 1, 1, 5])
    assert decode(block, run, shape, np.array([3.0, 3.0, -1.0, 3.0, -2.0])).tolist() == [True, True, True, True, False]
    assert decode(block, run, np.full(5, 5), np.array([3.0, 3.0, -2.0, 3.0, -2.0])).tolist() == [True, True, False, True, False]
    assert decode(np.array([], dtype=int), np.array([], dtype=int), np.array([], dtype=int), np.array([])).tolist() == []


def values_of(spark):
    """Pages with a body (trust 0), pages without (1), captures and errors; the notices are in no word list."""
    filler = "quorvel mintra sabelo drimmen fosk"
    data = [("p", n, "text", page(n, False)[0], 0, n) for n in range(60)] + [("p", 60, "text", "The guide prints `{{ price }}` as code for all owners of the lamp.", 0, 60)]
    data += [("p", 100 + n, "text", f"Sorry, our wombat ate this leaf number {n}.", 1, 100 + n) for n in range(5)]
    data += [("p", 110 + n, "text", page(110 + n, False)[0] + f"\nOnly {{{{ stock_{n} }}}} left.", 1, 110 + n) for n in range(5)]
    data += [("p", 120 + n, "text", " ".join(random.Random(n).choices(filler.split(), k=12)), 1, 120 + n) for n in range(8)]
    data += [("p", 130 + n, "error", "Message goes there", 1, None) for n in range(2)] + [("p", 140 + n, "error", f"timeout after {n} s", None, None) for n in range(30)]
    data += [
        ("c", 1, "text", "Sorry, our wombat ate this leaf number 77.", None, None), ("c", 2, "text", "Sory, our wombatt ate ths leef numbr 7.", None, None), ("c", 3, "text", page(300, False)[0], None, None),
        ("c", 4, "text", page(301, False)[0] + "\n\nCosts {{ cost }} now.", None, None), ("c", 5, "text", "It prints `{{ cost }}` as the tag does in code.", None, None), ("c", 6, "text", "fosk mintra fosk drimmen sabelo quorvel mintra", None, None),
        ("c", 7, "text", None, None, None), ("c", 8, "text", "", None, None), ("c", 9, "text", "word " * 20_000, None, None), ("c", 10, "error", "Message goes there", None, None),
    ]
    return spark.createDataFrame(data, "tab string, id long, part string, text string, trust int, copy long")


def test_residue(spark):
    values = values_of(spark)
    found = {(r.tab, r.id): r.trusted for r in residue_rows(values).collect()}
    assert sorted(i for t, i in found if t == "c") == [1, 2, 4, 6, 10]
    assert found["c", 1] and not found["c", 2]  # slips in most words: only a link to a trusted unit gives it
    pages = {i for t, i in found if t == "p"}
    assert {*range(100, 105), *range(110, 115), *range(120, 128), 130, 131} <= pages and not pages & {*range(61), *range(140, 170)}
    assert residue_rows(values.where("false")).count() == 0
    assert [r.id for r in residue_rows(values, values.where("tab = 'c' and id < 3").select("tab", "id")).orderBy("id").collect()] == [1, 2]


def test_partitions_reach_edit_similarity(spark):
    r = random.Random(8)
    base = [" ".join("".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 14))) for _ in range(300)]
    near = []
    for b in base:  # edits at random places, up to a tenth of the letters
        t = list(b)
        for _ in range(max(1, len(t) // 12)):
            t[r.randrange(len(t))] = r.choice("xyz")
        near.append("".join(t))
    frame = lambda texts, lo: spark.createDataFrame([(lo + n, t) for n, t in enumerate(texts)], "u long, unit string")
    found = {x.u for x in spread(frame(base, 0), frame(near + ["unlike all of these"], 1000)).collect()}
    assert len(found & set(range(1000, 1300))) >= 270 and 1300 not in found


def test_masks_equal_plain_patterns(spark):
    r = random.Random(5)
    bits = ["a", "f", "0", "12", "abc", "g", "9f", "-", "_", ".", ".com", ".example", "net", "www.", " ", "  ", "\t", "\r", "\n", "é", "٣", "İ", "A", "B9", "0x1F"]
    df = spark.createDataFrame([("".join(r.choice(bits) for _ in range(r.randrange(14))),) for _ in range(20_000)] + [(None,)], "text string")
    host = F.regexp_replace(F.lower("text"), r"(?<![\w-])(?:[\w-]++\.)+(?:example|com|org|net)\b", "host")
    number = F.regexp_replace(host, r"(?<![a-z0-9])[0-9a-f]*[0-9][0-9a-f]*+(?![a-z0-9])|[0-9]+", "0")
    plain = F.regexp_replace(number, r"[ \t\r]{2,}|[\t\r]", " ")
    assert masked(df).where(~F.col("masked").eqNullSafe(plain)).count() == 0


def bit_by_bit(units):
    out = np.empty((len(units), 64), dtype=np.uint8)
    padded = [f"\x02{u}\x03" for u in units]
    begin = np.cumsum([0] + [len(p) - 1 for p in padded])[:-1]
    codes = np.array([(ord(a), ord(b)) for p in padded for a, b in zip(p, p[1:])], dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = codes[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ codes[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    began = time.process_time()
    for bit in range(64):
        out[:, bit] = 2 * np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), begin) > np.diff(np.append(begin, len(h)))
    return out, time.process_time() - began


def test_simhash_equals_bit_by_bit_in_less_time():
    r = random.Random(9)
    units = ["".join(r.choices("abcdefgh ıé。", k=r.randrange(1, 140))) for _ in range(6000)]
    for some in (units[:200], ["b" * 254, "b" * 255, *units[:50]], ["ab" * 200], ["c" * 65_534, "c" * 65_535, "d"], ["", "x"]):
        assert np.array_equal(simhash(some), bit_by_bit(some)[0])
    took = []
    for _ in range(3):
        began = time.process_time()
        simhash(units)
        took.append(time.process_time() - began)
    assert 2 * min(took) < min(bit_by_bit(units)[1] for _ in range(3))  # all of it, against the counting alone


def test_trees_and_tokens_equal_plain_walks():
    import xxhash

    nodes = [(2, 0.5, 1, 2, 0.0), (0, -0.25, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.75), (-1, 0.0, 0, 0, -1.5), (1, 0.0, 5, 6, 0.0), (-1, 0.0, 0, 0, 2.0), (-1, 0.0, 0, 0, -3.0)]
    model = Model(np.zeros(1), [(1.0, nodes), (0.3, [(-1, 0.0, 0, 0, 0.5)])])

    def walk(row, at=0):
        f, threshold, left, right, value = nodes[at]
        return value if f < 0 else walk(row, left if row[f] <= threshold else right)

    x = np.vstack([np.random.default_rng(3).normal(size=(500, 3)), [[-0.25, 0.0, 0.5], [-0.25, 0.0, 0.6]]])
    assert np.array_equal(model.log_odds(x), [2 * (walk(row) + 0.3 * 0.5) for row in x]) and not len(model.log_odds(x[:0]))
    lines = ["", " ", "ΑΣ İstanbul 2,089.50 (½) a_b", "em\u2003space nel\x85 x", "y" * 60 + " 12", "12 12"]
    want = [[xxhash.xxh32_intdigest("0" if t.isdigit() else t) % BUCKETS for t in TOKEN.findall(s.lower()) or [""]] for s in lines]
    for _ in range(2):
        tokens, sizes = buckets_of(lines)
        assert tokens.tolist() == [t for w in want for t in w] and sizes.tolist() == [len(w) for w in want]


def test_tails():
    ends = lambda t: tails_of([t], None)[0][0]
    assert ends("A whole sentence stands here.") == "closed" and ends("") == "closed" and ends(None) == "closed" and ends("# Title") == "closed" and ends("| a | b |") == "closed"
    assert ends("A sentence that is long enough to be one was tested for ni") == "open"
    assert ends("The kettle was tested for [...]") == "mark" and ends("Body.\n\n- Weight: 12 g") == "item" and ends("| a | b") == "table" and ends("Short line") == "line"
    assert len(tails_of(["x " * 9] * 1200, None)) == 1200


def test_limits(spark):
    r = random.Random(2)
    lengths = [(1, r.randrange(500, 3000)) for _ in range(3000)] + [(1, 1200)] * 60
    found = rows(field_limits(spark.createDataFrame(lengths, "source int, n int")), "n")
    assert (1200,) in found and len(found) <= 2
    whole = lambda n: ("The kettle was tested for nine weeks by twelve people and held. " * 60)[: n - 1].rstrip() + "."
    cut = ["- " + ("item number of the list without an end " * 20)[:398]] * 30  # items that all end at 400 characters
    data = [("p", n, "h", "s", whole(r.randrange(300, 900))) for n in range(400)] + [("p", 1000 + n, "h", "s", c) for n, c in enumerate(cut)]
    data += [("p", 2000, "h", "s", "An open sentence that ends in the mid of a wo"), ("p", 2001, "h", "s", None), ("p", 2002, "h", "s", "- an item"), ("p", 2003, "h", "s", "Marked here [...]"), ("p", 2004, "h", "s", "Never mind {{ x }} that ends in the mid of a wo")]
    df = spark.createDataFrame(data, "tab string, id long, host string, scraper string, text string")
    values = df.select("tab", "id", F.lit("text").alias("part"), "text", F.lit(None).cast("int").alias("trust"), F.col("id").alias("copy"))
    got = {x.id: x.reason for x in judged(df, values, None).where("reason is not null").collect()}
    assert got == {2000: "transfer", 2003: "mark"} | {1000 + n: "limit" for n in range(30)}
    assert judged(df.where("false"), values.where("false"), None).count() == 0


# problem 7


def test_listings(spark):
    data = [
        ("u1", "Dalvimar Dorn 5213 portable charger 26800 mAh", "Dalvimar Inc.", None, 66.0), ("u2", "DORN DR-5213, power bank, 26.8 Ah", None, "26,800 mAh Dorn 5213 black NEW", 65.0), ("u3", "Dorn 5213 Pro power bank 26.8 Ah", "Dalvimar", None, 66.0),
        ("u4", "Doorn 5213 charger 26800mAh", "dalvimar", None, 67.0), ("u5", "Vesper 5213 power bank 26800 mAh", "Ombrix", None, 20.0), ("u6", "Dorn 5213 charger 10000 mAh", "Dalvimar", None, 40.0), ("u7", "gift card", "Dalvimar", None, 40.0), (None, "Dorn 5213 26800 mAh", None, None, 1.0),
    ]
    df = spark.createDataFrame(data, "canonical_url string, product_name string, brand string, listing_title string, normalized_price_usd double")
    got = dict(rows(linked(df)))
    assert got["u1"] == got["u2"] == got["u4"] and len({got[u] for u in ("u1", "u3", "u5", "u6")}) == 4 and "u7" not in got
    assert linked(df.where("false")).count() == 0
    fitted = fit_weights([{"brand": 1, "line": 2, "price": 1, "n": 100}, {"brand": 0, "line": 0, "price": 0, "n": 300}])
    assert fitted[1, 2, 1] > 0.9 > 0.1 > fitted[0, 0, 0]


def test_listings_of_any_model_number(spark):
    data = [
        ("a1", "Acme X200 electric kettle 1.7 L", "Acme", None, 40.0), ("a2", "kettle X-200, 1700 ml", "ACME Inc.", None, 42.0), ("a3", "X 200 Pro water boiler 1.7 litre", "Acme", None, 41.0), ("a4", "Acme X300 kettle 1.7 L", "Acme", None, 41.0),
        ("b1", "Dorn 800 charger 26.8 Ah", "Dalvimar", None, 60.0), ("b2", "DORN DR-800 power bank", "Dalvimar", "Donr DR800 26,800 mAh", 61.0), ("b3", "Vesper 800 charger 26800 mAh", "Ombrix", None, 20.0), ("b4", "Dorn 800 charger 10 Ah", "Dalvimar", None, 60.0),
        ("c1", "Dorn 52134 charger", None, None, 60.0), ("c2", "dorn DR52134 power bank", "Dalvimar", None, 60.0), ("d1", "Fone 14 Pro 256GB", "Acme", None, 900.0), ("d2", "FONE 14 pro, 256 gb", "Acme", None, 910.0), ("d3", "Fone 15 Pro 256GB", "Acme", None, 900.0),
        ("e1", "800 ml mug, save 20%", "Acme", None, 8.0), ("e2", "mug 0.8 L USD 800", "Acme", None, 8.0), ("f", None, None, None, None), ("g", "", None, None, None), ("h1", "800", None, None, None), ("h2", "800", None, None, None), (None, "Dorn 800", None, None, 1.0),
    ]
    df = spark.createDataFrame(data, "canonical_url string, product_name string, brand string, listing_title string, normalized_price_usd double")
    groups = defaultdict(set)
    for url, cluster in rows(grouped(df)):
        groups[cluster].add(url)
    assert sorted(map(sorted, groups.values())) == [["a1", "a2"], ["a3"], ["a4"], ["b1", "b2"], ["b3"], ["b4"], ["c1", "c2"], ["d1", "d2"], ["d3"], ["e1"], ["e2"], ["f"], ["g"], ["h1"], ["h2"]]
    assert {r.url for r in linked(df).collect()} == {x[0] for x in data if x[0]} - {"e1", "e2", "f", "g"}
    assert grouped(df.where("false")).count() == 0
    texts = ["1000W heater", "gift card USD 500", "pack of 12", "up to 500 reviews", "2in1 tool, 100x200 cm", "65QN90B television", "Onyx ON 213-Gen 2", "Acme WH-100XM4"]
    got = [next((x for x in r if x), None) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(*readings(F.col("text"))).collect()]
    assert got == [None] * 5 + ["65qn90b||", "213|onyx|gen2", "wh100xm4|acme|"]

import random
import re

import numpy as np
import xxhash

from inkveil.llm.common import words_of
from inkveil.llm.line_dedup import BYTE_VALUES, LONG_WORD, LineRules, dedup_lines, op5_line_dedup, shape, without_repeats, without_words, word_hashes
from tests.llm.edge import empty, frame, prose

RULES = LineRules()
MASK = (1 << 64) - 1


def mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def word_hash(word):
    if len(word) > LONG_WORD:
        return xxhash.xxh3_64_intdigest(word)
    values = [int(v) for v in BYTE_VALUES]
    return mix(sum(values[b] * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) + len(word) & MASK)


def split(text, rules=RULES):
    """Lines of words by the rule: of every ``reach`` pairs on a physical line the least ends a line."""
    out = []
    for line in text.encode().split(b"\n"):
        words = line.split()
        hashes = [word_hash(w) for w in words]
        pairs = [mix((h * 0x9E3779B97F4A7C15 + (hashes[i + 1] if i + 1 < len(hashes) else 0)) & MASK) for i, h in enumerate(hashes)]
        ends = {len(words) - 1}
        for i in range(len(pairs) - rules.reach + 1):
            least = min(pairs[i : i + rules.reach])
            ends |= {j for j in range(i, i + rules.reach) if pairs[j] == least}
        own = []
        for i, word in enumerate(words):
            own.append(word)
            if i in ends:
                out.append(own)
                own = []
    return out


def windows_of(lines, rules=RULES):
    """By line the words of its window and where it ends, as long as there is one."""
    out = []
    for i in range(len(lines)):
        end = i + rules.window
        while end <= len(lines) and sum(map(len, lines[i:end])) < rules.min_words:
            end += 1
        if end > len(lines):
            break
        out.append((tuple(w for line in lines[i:end] for w in line), end))
    return out


def brute(docs, rules=RULES):
    """Texts by id, each window compared by its words with all before it, and edges word by word."""
    shapes, places = {}, {}
    for doc, text in sorted(docs):
        lines = split(text, rules)
        begins = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
        own = windows_of(lines, rules)
        shapes[doc] = [w for line in lines for w in line], begins, own
        for i, (words, _) in enumerate(own):
            places.setdefault(words, []).append((doc, i))
    out = {}
    for doc, text in docs:
        words, begins, own = shapes[doc]
        later = [i for i, (window, _) in enumerate(own) if places[window][0] != (doc, i)]
        gone = np.zeros(len(words), dtype=bool)
        for i in later:
            first_doc, first_at = places[own[i][0]][0]
            there, there_begins, there_own = shapes[first_doc]
            edges = [0, *np.cumsum([len(line.split()) for line in text.split("\n")]).tolist()]
            before = behind = 0
            a, b = begins[i], there_begins[first_at]
            while i - 1 not in later and before < min(a, b, rules.around) and words[a - before - 1] == there[b - before - 1]:
                before += 1
            room = a - max(e for e in edges if e <= a)
            before = min(before, room) if before < room + rules.over_break else before
            a, b = begins[own[i][1]], there_begins[there_own[first_at][1]]
            most = min(len(words) - a, len(there) - b, rules.around)
            while i + 1 not in later and behind < most and words[a + behind] == there[b + behind]:
                behind += 1
            room = min(e for e in edges if e >= a) - a
            behind = min(behind, room) if behind < room + rules.over_break else behind
            gone[begins[i] - before : begins[own[i][1]] + behind] = True
        starts = np.array([m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())], dtype=np.int64)
        out[doc] = without_words(text.encode(), starts, gone).decode()
    return out


def corpus():
    rng = random.Random(3)
    passage = prose(7777, 70)
    docs = []
    for i in range(120):
        text = prose(i, rng.randint(30, 150))
        if i % 4 == 0:
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], passage, *words[at:]])
        docs.append((i, text))
    docs += [(500 + i, docs[i][1]) for i in range(5)]
    return docs, passage


def test_matches_brute_force(spark):
    docs, _ = corpus()
    for bits in (26, 6):  # the smaller map lets nearly all windows pass
        got = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), LineRules(filter_bits=bits))
        assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(docs)


def test_planted_passages_go_and_clean_texts_stay(spark):
    docs, passage = corpus()
    got = {r["doc_id"]: r for r in op5_line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    texts, n = dict(docs), len(words_of(passage))
    assert got[0]["text"] == texts[0]  # the first occurrence
    for i in range(1, 120):
        gone = len(words_of(texts[i])) - len(words_of(got[i]["text"]))
        assert 0.6 * n <= gone <= n + 30 if i % 4 == 0 else got[i]["text"] == texts[i]
    assert all(not got[500 + i]["text"].strip() for i in range(5))


def test_repeats_within_a_text(spark):
    lines = ["one two three four", "five six seven", "eight nine ten eleven"]
    text = "\n".join([*lines, "between", *lines, "after"])
    (row,) = op5_line_dedup(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row["text"] == "\n".join([*lines, "between", "after"])
    assert (row["n_lines"], row["n_removed"]) == (8, 3)


def lines_of(text):
    own, words = shape([text.encode()], RULES), text.encode().split()
    return [words[a:b] for a, b in zip(own.begins, own.ends)]


def test_lines_end_where_the_rule_says():
    for seed in range(100):
        rng = random.Random(seed)
        text = prose(seed, rng.randint(0, 150), rng.choice([2, 10, 400]))
        lines = split(text)
        assert lines_of(text) == lines
        own = shape([text.encode()], RULES)
        found = windows_of(lines)
        assert own.whole.sum() == len(found) and own.whole[: len(found)].all()
        sizes = np.cumsum([len(line) for line in lines])
        assert own.window_ends[: len(found)].tolist() == [sizes[end - 1] for _, end in found]
        # Equal windows and no others have equal hashes.
        assert len(set(zip(own.windows.tolist(), [w for w, _ in found]))) == len({w for w, _ in found})


def test_word_hashes_over_several_parts(monkeypatch):
    from inkveil.llm import line_dedup

    text = " ".join([prose(1, 300), "x" * 5000, "ü", "y" * 4097, "z" * 4096, prose(2, 50)]).encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    starts, ends = np.array(spans).T
    for size in (1 << 20, 100, 1):
        monkeypatch.setattr(line_dedup, "_AT_A_TIME", size)
        got = word_hashes(np.frombuffer(text, dtype=np.uint8), starts, ends)
        assert got.tolist() == [word_hash(text[a:b]) for a, b in spans]


def test_several_texts_at_once_have_the_windows_of_each():
    texts = [t.encode() for t in (prose(1, 90), "", "a b\n c", prose(2, 12), prose(1, 90), " \n ")]
    together = shape(texts, RULES)
    for i, text in enumerate(texts):
        alone, mine = shape([text], RULES), together.text == i
        assert together.windows[mine & together.whole].tolist() == alone.windows[alone.whole].tolist()
        assert (together.ends - together.begins)[mine].tolist() == (alone.ends - alone.begins).tolist()


def test_lines_are_wrapped_alike_in_any_place():
    passage = prose(5, 80).replace("\n", " ")
    inside = {tuple(w) for w in split(passage)}
    for i in range(20):
        text = prose(i + 50, 40).replace("\n", " ") + " " + passage + " " + prose(i + 90, 40)
        found = split(text)
        assert len(inside - {tuple(w) for w in found}) <= 6
        assert [x for w in found for x in w] == text.encode().split()


def test_edges(spark):
    docs = frame(spark)
    got = dedup_lines(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "n_lines", "n_removed"})
    assert got.count() == docs.count()
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[2] == [None] and texts[1] == [""] and len(set(texts[5])) == 1 and len(texts[5]) == 2
    assert words_of(texts[6][0]) == [] and words_of(texts[5][0]) != []
    left = without_repeats(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 6 not in ids and ids.count(5) == 2 and 1 in ids
    assert without_repeats(empty(spark)).count() == 0 and op5_line_dedup(empty(spark)).count() == 0


def planted(marks, joint, words=51, copies=40):
    """Texts around copies of one passage, each at a random word; no sentence marks without ``marks``."""
    rng = random.Random(11)
    clean = lambda ws: [w if marks else w.rstrip(".") for w in ws]
    passage = clean(prose(4242, words).split())
    docs = []
    for i in range(copies):
        own = clean(prose(9000 + i, 160).split())
        at = rng.randrange(1, len(own))
        docs.append((i, own[:at], own[at:]))
    return passage, docs, [(i, joint.join([*a, *passage, *b])) for i, a, b in docs]


def test_passages_of_51_words_go_from_end_to_end(spark):
    for marks, joint in ((True, " "), (False, " "), (False, "\n")):
        passage, parts, docs = planted(marks, joint)
        got = {r["doc_id"]: r["text"] for r in op5_line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got[0] == docs[0][1]
        for i, before, behind in parts[1:]:
            # The words next to a passage may by chance be those next to its first copy.
            assert abs(len(got[i].split()) - len(before + behind)) <= 2, (marks, joint, i)


def test_47_words_hold_a_whole_window():
    for seed in range(60):
        passage = " ".join(w.rstrip(".") for w in prose(700 + seed, 47).split())
        both = []
        for i in (1, 2):
            own = " ".join(prose(seed * 10 + i, 40 + i).split())
            both.append({w for w, _ in windows_of(split(f"{own} {passage} {own} "))})
        assert {w for w in both[0] & both[1] if " ".join(x.decode() for x in w) in passage}


def test_the_query_on_a_whole_table(spark, sf_dir):
    """The registered form against brute force, passages inside lines and lengthened windows included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = {r["doc_id"]: r["text"] or "" for r in op5_line_dedup(docs).collect()}
    assert got == brute(rows)


def test_long_texts_and_ties(spark):
    word, line = "word " * 300_000, " ".join(prose(1, 40_000).split())
    docs = [(1, word), (2, " " * 2_000_000), (3, "\n" * 2_000_000), (4, line), (5, line), (5, line), (6, "x" * 2_000_000), (7, line + " y")]
    got = {}
    for r in op5_line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[4] == [line] and got[5] == ["", ""] and got[7] == ["y"]
    assert got[2] == [docs[1][1]] and got[3] == [docs[2][1]] and got[6] == [docs[6][1]]
    assert len(got[1][0].split()) < 20  # its first window stays


def test_clashing_columns_stay(spark):
    names = ["key", "row", "cut", "places", "n", "h", "hash", "at", "__text", "__key", "__h", "__doc", "__cut", "__at", "kept"]
    own = ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, prose(1, 60), *range(i, i + len(names))) for i in (1, 2)], f"doc_id bigint, text string, {own}")
    done = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert all(done[i][n] == i + k for i in (1, 2) for k, n in enumerate(names))
    assert [tuple(r) for r in without_repeats(docs).collect()] == [tuple(docs.filter("doc_id = 1").first())]


def test_short_lines_are_joined_into_windows(spark):
    rng = random.Random(8)
    shared = [[f"item{i}", "of", f"list{i % 3}"][: 1 + i % 3] for i in range(12)]  # 24 words on 12 lines
    docs = []
    for i in range(20):
        own = lambda n: [f"{rng.random()} alone" for _ in range(n)]
        docs.append((i, "\n".join([*own(5), *[" ".join(w) for w in shared], *own(4)])))
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0]["text"] == docs[0][1]
    for i, text in docs[1:]:
        lines = text.split("\n")
        assert got[i]["text"].split("\n") == lines[:5] + lines[17:] and got[i]["n_removed"] == 12


def test_windows_are_counted_and_gathered_in_parts(spark, monkeypatch):
    """Small parts of all that a task holds give the same texts, rows alike and NULL ids among them."""
    from inkveil.llm import line_dedup

    docs, _ = corpus()
    docs += [docs[4], docs[8], docs[8], (None, docs[12][1]), (None, docs[12][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)

    def found():
        rows = dedup_lines(frame).collect()
        return sorted(((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_removed"]) for r in rows))

    whole = found()
    assert len(whole) == len(docs) and any(r[3] for r in whole)
    for name, value in (("_HELD", 7), ("_HELD_ROWS", 3), ("_PART_BITS", 20), ("_AT_A_TIME", 50), ("MOST_EDGES", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    assert found() == whole


def test_repeated_windows_make_the_map(spark):
    """Hashes that occur twice or more, in one row or in several, and no others."""
    from inkveil.llm.line_dedup import _repeated_map

    hashes = [[1, 1, 2, 70, 3 + (1 << 63)], [3, 2, 2, 2], [5], [70, 6, 1 << 14, (1 << 14) + 9]]
    lines = spark.createDataFrame([(bytearray(np.array(h, dtype=np.uint64).tobytes()),) for h in hashes], "windows binary")
    bits = _repeated_map(lines, LineRules(filter_bits=16)).value
    set_bits = [64 * i + j for i, word in enumerate(bits.tolist()) for j in range(64) if word >> j & 1]
    assert set_bits == [1, 2, 70]

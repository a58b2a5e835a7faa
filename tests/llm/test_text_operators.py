"""Each operator against a plain brute-force version on small, awkward tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tokenizers import Tokenizer

from practicum.llm import chat_format, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, substring_dedup, token_output, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 90))))
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            out.append(" ".join(copy) + (" tail" if rng.random() < 0.2 else ""))
    return out + [None, "", " \n ", "one", "one", "One two", "a b c d e", "A b c d E", " ".join(["x"] * 400), "é ü\nü é " * 30]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(sets)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("most_parts", [1, 100])
def test_ngram_classes_equal_all_pairs(docs, texts, monkeypatch, most_parts):
    monkeypatch.setattr(ngram_join, "MOST_PARTS", most_parts)
    rows = ngram_join.classes_of(docs, shard_shingles=150).collect()
    assert len(rows) == len(texts) + 4
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == brute_classes(texts)
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]


def test_ngram_search_finds_links_that_leaders_hide():
    """A chain: each text links to the next only, so members of stars have to be compared."""
    sets = [np.arange(i * 12, i * 12 + 100, dtype=np.uint64) for i in range(8)]
    shard = ngram_join.Shard(75)
    for k in (3, 1, 5, 0, 7, 2, 6, 4):
        shard.add(k, None, sets[k])
    assert {root for _, root in shard.result()} == {0}


def test_ngram_keeps_one_of_each(docs, texts, empty):
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    classes = brute_classes(texts)
    assert ids == sorted(i for i, (n, c) in classes.items() if c == i or not n)
    assert ngram_join.classes_of(empty).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_chains_and_stars(spark, one_task):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(spark, edges, one_task=one_task).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


@pytest.mark.parametrize("width,most", [(3, 1000), (3, 7), (13, 50)])
def test_fm_index_equals_scanning(width, most):
    rng = np.random.default_rng(width + most)
    for _ in range(25):
        items = [(str(i), " ".join(rng.choice(list("abcde"), rng.integers(0, 16)))) for i in range(6)]
        texts = [" ".join(rng.choice(list("abcdefz"), rng.integers(0, 60))) for _ in range(5)] + [None, "", "A-b_C"]
        phrases = decontaminate.Phrases(items, width)
        together = list(decontaminate._hits(pa.array(texts, pa.string()), phrases, 10_000))
        assert together == [next(decontaminate._hits(pa.array([t], pa.string()), phrases, most)) for t in texts]
        for t, (n, spans, names) in zip(texts, together, strict=True):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
            hit, found = set(), set()
            for i, y in items:
                v = y.split()
                k = min(width, len(v))
                for s in range(len(v) - k + 1 if k else 0):
                    for a in range(len(w) - k + 1):
                        if w[a : a + k] == v[s : s + k]:
                            hit |= set(range(a, a + k))
                            found.add(i)
            assert n == len(w) and names == sorted(found) and hit == {k for a, b in spans for k in range(a, b)}


def test_decontamination_blocks_and_empty_sides(spark, docs, texts, empty):
    items = spark.createDataFrame([(1, " ".join(words(texts[0])[5:30])), (2, texts[3]), (3, None), (None, "one"), (4, "")], "item_id long, text string")
    one, names = decontaminate.flag_documents(docs, items)
    many, _ = decontaminate.flag_documents(docs, items, block_chars=40)
    key = lambda d: sorted(map(repr, d.select(names["doc_id"], "n_words", "n_hit", "spans", "contaminated").collect()))
    assert key(one) == key(many)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(empty, items).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<\\\\s>[\\/INST]", "", None, "a\nb", "<s><s>", "[[INST]]", "$1 \\$2"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "user", "hi"), (3, None, None, "x"), (3, 0, "assistant", "y"), (None, 0, "assistant", "z"), (4, 0, "tool", "[INST]"), (4, 0, "tool", "[INST]")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.format_conversations(table)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for *_, role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.where("trainable").collect():
        assert e.formatted[e.loss_start : e.loss_end] == e.target[e.target.index("[INST]") + 6 : -7]
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_language_id_learns_and_holds_out(spark, empty):
    rng = np.random.default_rng(2)
    stock = {"en": ["the", "thing", "water", "with"], "de": ["der", "schön", "über", "nicht"], "es": ["niño", "los", "agua", "para"]}
    rows = [(i, " ".join(rng.choice(stock[lang], 30)), lang, "s", 1) for i, lang in enumerate(rng.choice(list(stock), 400))]
    docs = spark.createDataFrame(rows + [(None, "the water", "en", None, None), (900, None, "en", None, None), (901, "123 !!", None, None, None), (902, "", None, None, None)], DOC)
    texts, labels = language_id.sample(docs)
    held = {t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert texts and not held & set(texts)
    found, names = language_id.identify(docs, language_id.train(texts, labels))
    out = {r[names["doc_id"]]: r for r in found.collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.98
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and out[None].lang_pred == "en"
    assert language_id.sample(empty) == ([], [])
    assert {r.lang_pred for r in language_id.identify(docs, None)[0].collect()} == {"und"}


def test_url_rules(spark):
    urls = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://EXAMPLE.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"), "x.net/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "https://b.example.com/de/?": ("b.example.com", "/de/", "example.com/de/", "block"), "http://w.org/fr/a://b": ("w.org", "/fr/a://b", "org/fr/", "allow"),
        "http://casino.example.com/en/": ("casino.example.com", "/en/", None, "block"), "http://x.com/login": ("x.com", "/login", None, "block"), "http://net:80/": ("net:80", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, html string")
    for limit in (512, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, inline_limit=limit).collect()}
        assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_quality_counts_and_pass_through(spark, docs, texts, empty):
    def repeats(w):
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)})

    rows = {r._row.c0: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].n_words, rows[i].n_repeat_words) == (len(words(t)), repeats(words(t)))
    extra = docs.withColumnsRenamed({"n_chars": "n_words"}).withColumn("kept", docs["doc_id"])
    out = quality.filter_documents(extra)
    assert out.columns == extra.columns and 0 < out.count() < docs.count()
    assert quality.judge(empty).count() == 0


def test_quality_fences_adapt_and_spare_clean_groups(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(40)), "en", "a", 0) for i in range(120)]
    junk = [(1000 + i, " ".join(f"w{k} #$%" for k in range(20)), "en", "a", 0) for i in range(6)]
    kept = {r.doc_id for r in quality.filter_documents(spark.createDataFrame(clean + junk, DOC)).collect()}
    assert kept == {r[0] for r in clean}


def brute_runs(rows, least):
    """(doc, text) rows to (doc, start, stop, words, first doc) of the runs that go, by plain scanning."""
    cut = []
    for doc, text in rows:
        found = []
        for m in re.finditer(r"[^\n]*?(?:[.!?](?=[ \t\n\x0b\x0c\r]|$)|[\u3002\uff01\uff1f])|[^\n]+", text or ""):
            if own := list(re.finditer(r"[^\x20\x09-\x0D]+", m.group())):
                found.append((m.start() + own[0].start(), m.start() + own[-1].end(), tuple(w.group().translate(LOW) for w in own)))
        cut.append((doc, text, found))
    place = lambda doc, text: (doc is None, doc or 0, text if doc is None else "")
    first = {}
    for doc, text, found in cut:
        for n, (*_, unit) in enumerate(found):
            first[unit] = min(first.get(unit, (place(doc, text), n)), (place(doc, text), n))
    want = set()
    for doc, text, found in cut:
        seen, runs, last = set(), [], None
        for n, (start, stop, unit) in enumerate(found):
            going = unit in seen or place(doc, text) != first[unit][0]
            seen.add(unit)
            if going and last == n - 1:
                runs[-1] = (runs[-1][0], stop, runs[-1][2] + len(unit), runs[-1][3])
            elif going:
                runs.append((start, stop, len(unit), first[unit][0]))
            last = n if going else last
        want |= {(doc, a, b, n, None if f[0] else f[1]) for a, b, n, f in runs if n >= least or b - a >= 10 * least}
    return want


def test_substring_dedup_equals_scanning(spark, empty):
    rng = np.random.default_rng(8)
    stock = [" ".join(rng.choice(["One", "two", "THREE", "four5", "\u00e9t\u00e9"], int(rng.integers(1, 6)))) + rng.choice([".", "!", "?", ",", ". ", "\n", "\u3002"]) for _ in range(25)]
    rows = [(int(rng.integers(0, 30)), (" " if rng.random() < 0.8 else "").join(rng.choice(stock, int(rng.integers(1, 14))))) for _ in range(40)]
    passage = "One two three four five six seven eight nine. Short one. Ten eleven twelve thirteen fourteen fifteen sixteen seventeen!"
    rows += [(103, f"Intro a b c.\n{passage} Then the rest of it is new here today."), (101, f"{passage}  Unlike anything else that was ever said."), (107, passage), (108, "Clean words only, nothing of it repeats."), (109, None), (110, ""), (111, " \n\t"), (None, passage), (None, f"x. {passage}"), rows[0]]
    rows += [(112, "Quite another text under this number, with words of its own."), (112, passage), (113, "\u6f22\u5b57\u3002" * 12), (114, "w " * 5000 + ". " + passage)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)
    for least in (1, 6, 16):
        got = {(r.doc_id, r.start, r.stop, r.n_words, r.first_doc_id) for r in substring_dedup.repeats(docs, min_words=least).collect()}
        assert got == brute_runs(rows, least)
    extra = docs.withColumnsRenamed({"lang": "a.b", "source": "_t"})
    out = substring_dedup.remove_repeats(extra, min_words=16)
    assert out.columns == [*extra.columns, "removed"]
    cut = {(r.doc_id, r.text): r.removed for r in out.collect()}
    assert (112, rows[-4][1]) in cut and cut[(112, "")] and (103, "Intro a b c.\n Then the rest of it is new here today.") in cut
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs.withColumn("removed", docs["lang"]))
    assert substring_dedup.remove_repeats(docs, removed="gone", min_words=16).columns[-1] == "gone"
    assert substring_dedup.repeats(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 127, 128, 129, 3000):
        for v in (2, 300, 50257):
            ids = rng.integers(0, v, n).astype(np.int32)
            ids[n // 2 :] = ids[: n - n // 2]
            packed = token_output.compress(ids, v)
            assert (token_output.decompress(packed) == ids).all()
    broken = bytearray(packed)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_output.decompress(bytes(broken))


def test_cut_equals_the_pattern():
    """The vectorised cut against the pattern itself, on texts full of quotes and blanks."""
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    rng = np.random.default_rng(3)
    atoms = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "s", "B\u00e9", "12", "!", "_", "\u00ab", "\u0436", "x y", "don't", "\r\n"]
    for _ in range(400):
        texts = ["".join(rng.choice(atoms, int(rng.integers(0, 14)))) for _ in range(5)] + ["x"]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        assert token_output.cut(points, off).tolist() == [m.start() + o for t, o in zip(texts, off, strict=False) for m in pattern.finditer(t)]


def test_long_texts_are_sliced_between_words(monkeypatch):
    monkeypatch.setattr(token_output, "SLICE_CHARS", 50)
    library = Tokenizer.from_file(token_output.default_tokenizer())
    encoder = token_output.Encoder(token_output.default_tokenizer())
    for text in ("it's a test of  words\n\nand don't stop, it goes on 12 3 and on " * 9, "x" * 400, " \n" * 90):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_tokens_equal_the_library(spark, docs, texts, empty):
    library = Tokenizer.from_file(token_output.default_tokenizer())
    odd = ["it's  a b \n\n x<|endoftext|>y", "漢字 'll १२ ² x\u00a0y", "a\u2003b  ", "É'S don't 12ab_c"]
    rows = [(i, t) for i, t in enumerate(texts + odd)] + [(None, "null id"), (0, texts[0])]
    got = token_output.write_and_read(spark.createDataFrame(rows, "doc_id long, text string"), block_ids=500, partitions=3).collect()
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, want))
    assert token_output.write_and_read(empty).count() == 0


def test_mixing_budgets(docs, empty, texts):
    for ranges in (50_000, 3):
        rows = mixing.mix(docs, range_rows=ranges).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r["size"]
            by.setdefault(r.source, []).append(r)
        for own in by.values():
            assert own[0].source_size == sum(r["size"] for r in own)
            assert sum(r.taken for r in own) == int(own[0].target)
            assert own[0].target <= 3 * own[0].source_size
        assert abs(sum(own[0].target for own in by.values()) - sum(r["size"] for r in rows)) < 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mix(docs).collect()))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_line_dedup_equals_all_pairs(spark, empty, most):
    rng = np.random.default_rng(most)
    lines = ["".join(rng.choice(list("abc"), int(rng.integers(7, 14)))) for _ in range(40)]
    for line in list(lines[:25]):
        s = list(line)
        for _ in range(int(rng.integers(0, most + 1))):
            at, kind = int(rng.integers(len(s))), rng.integers(3)
            if kind == 0:
                s[at] = "z"
            elif kind == 1:
                s.insert(at, "z")
            elif len(s) > 4:
                del s[at]
        lines.append("".join(s))
    rows = [(i, "\n".join(lines[k :: 9])) for i, k in enumerate(range(9))] + [(20, None), (21, ""), (None, lines[0])]
    docs = spark.createDataFrame(rows + [rows[2]], "doc_id long, text string")
    every = [(d is None, d or 0, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if len(x) >= 6]
    first = {}
    for none, d, n, x in sorted(every):
        first.setdefault(x, (none, d, n))
    want = set()
    for none, d, n, x in every:
        near = [(first[y], edits(x, y)) for y in first if y != x and first[y] < first[x] and edits(x, y) <= most]
        if near or (none, d, n) != first[x]:
            to, k = min(near) if near else (first[x], 0)
            want.add((None if none else d, n, None if to[0] else to[1], to[2], k))
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.distance) for r in line_dedup.duplicates(docs, max_edits=most, min_chars=6).collect()}
    assert got == want
    assert line_dedup.duplicates(empty).count() == 0


def test_short_lines_go_where_equal(spark):
    rows = [(1, "All rights reserved.\n\nx"), (2, "All rights reserved!\n\n  All rights reserved.\nx"), (3, "All rights reserved")]
    got = line_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(2, 2, 1, 0, 0), (2, 3, 1, 2, 0)}


def test_line_removal_keeps_other_rows_lines(spark):
    rows = [(1, "the first line of all\n  kept as it is "), (2, "the first line of all\nown"), (2, "something of its own\nthe first line of all"), (3, None), (None, "the first line of all")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `a.b` string, _gone string")
    out = line_dedup.remove_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r[0] or 9, r[1] or "") for r in out.collect()) == [(1, rows[0][1]), (2, "own"), (2, "something of its own"), (3, ""), (9, "")]
    assert line_dedup.remove_duplicates(docs.limit(0)).count() == 0


def test_registered_line_dedup_finds_a_changed_word(spark, tmp_path):
    line = "This report was written for the members of the committee and for nobody else, page after page."
    rows = [(1, line), (2, "Something new.\n" + line.replace("nobody", "somebody")), (3, line.replace("new", "old").replace("written", "read"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()] == [(2, 1, 1, 0, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_ngram_shard_equals_all_pairs_of_hot_groups(seed):
    """Many near copies around the threshold: long lists, many candidates, stars with far members."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10_000, 120, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(85, 121)), replace=False), rng.integers(10_000, 20_000, int(rng.integers(0, 12)))])).astype(np.uint64) for _ in range(150)]
    shard, up = ngram_join.Shard(75), list(range(150))
    for k, s in enumerate(sets):
        shard.add(k, None, s)

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in combinations(range(150), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert shard.result() == [(k, find(k)) for k in range(150)]


def test_ngram_join_repeated_rows_in_two_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD_SHINGLES", 400)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(24) for _ in range(3)]
    got = ngram_join.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 0) for i, _ in rows]


def test_ngram_blocks_are_joined_by_texts(spark, monkeypatch):
    """Edges of blocks are counted in texts; shingles, of which each text has many, are no nodes."""
    seen = []

    def counted(session, edges):
        seen.append(edges.distinct().count())
        return components(session, edges)

    components = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", counted)
    rows = [(100 * block + token, 10 * block + doc, doc, 40) for block in range(2) for token in range(30) for doc in range(4) if token or doc < 3]
    cells = ngram_join._cells(spark, spark.createDataFrame(rows, "token long, doc_id long, comp long, n long"), 1000)
    by_cell = {}
    for r in cells.collect():
        by_cell.setdefault(r.cell, set()).add(r.doc_id)
    assert sorted(map(sorted, by_cell.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert seen[0] <= len(rows) // 28


def test_line_join_puts_out_links_only(spark, monkeypatch):
    """Lines of one key that differ by two insertions of a few characters pass the parities but are no links."""
    base = "this very common line stands in all of the documents, with a few edits"
    lines = [base] + [base[: 2 * k + 2] + "aabb" + base[2 * k + 2 :] for k in range(30)] + [base + "!"]
    made, write = {}, line_dedup.scratch

    def kept(session, df, tag, **options):
        made[tag] = write(session, df, tag, **options)
        return made[tag]

    monkeypatch.setattr(line_dedup, "scratch", kept)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.distance) for r in line_dedup.duplicates(docs).collect()}
    first = {j: min((i, edits(lines[i], x)) for i in range(j) if edits(lines[i], x) <= 3) for j, x in enumerate(lines) if any(edits(lines[i], x) <= 3 for i in range(j))}
    assert got == {(j, i, d) for j, (i, d) in first.items()}
    links = sum(edits(x, y) <= 3 for x, y in combinations(lines, 2))
    assert made["line-pairs"].count() == links

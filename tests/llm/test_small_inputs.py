"""The other operators against brute force on awkward small inputs."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, html_diff, mixing, packing, pii, topk, toxicity, wavelet
from tidewire.llm.queries import _tokenizer

TEXTS = [None, "", " ", "one", "one ", "One  two\n\nthree's 1,234 été", "a b c " * 30_000, "same text here", "same\t text here", "x" * 9000, "x" * 9000 + "y", "<|endoftext|> 　Жук ǅ ßς"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 37, t, "clash", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "lost", "c", 0, 0), (99, "twice", "c", 0, 0), (99, "twice", "c", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, n int, row int")


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]


@pytest.mark.parametrize("key", ["hash", "weak"])
def test_exact_dedup(spark, docs, key):
    from pyspark.sql import functions as F

    use = F.xxhash64 if key == "hash" else lambda b: F.length(b).cast("long")
    got = exact_dedup.exact_dedup(docs, block_chars=512, key=use).collect()
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in given(docs)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def _ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer(name))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs):
    got = packing.pack(docs, _tokenizer("byte_bpe_50k.json"), window=64).collect()
    rows = given(docs)
    want = sorted((i, x.tobytes()) for (i, _), x in zip(rows, _ids("byte_bpe_50k.json", [t for _, t in rows], 0), strict=True))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens, r.length))
    assert sorted({i for i, _ in want}) == sorted(by)
    for i, ids in want:
        pieces = sorted(by[i])
        repeat = sum(j == i for j, _ in want)
        assert sum(p[3] for p in pieces) == repeat * len(ids) // 4 and all(p[1] == ids[4 * p[0] : 4 * (p[0] + p[3])] for p in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), _tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("sizes", [[600] * 500, [700, 90] * 100, [1] * 3000, [63, 64, 65] * 50, [], [5]])
def test_packer_leaves_no_slack(sizes):
    """Every token once, and only the last sequence padded, also where no rests fill a window together."""
    packer, pieces = packing.Packer(1024), []
    for i, n in enumerate(sizes):
        pieces += packer.add(i, n)
        if i % 64 == 63:
            pieces += packer.exact()
            pieces += packer.rest(100)
            assert packer.count <= 100 or sum(k * len(v) for k, v in packer.waiting.items()) < 1024
    pieces += [*packer.exact(), *packer.rest()]
    used = {}
    for doc, start, length, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + length
    assert sorted(used.values())[1:] == [1024] * (len(used) - 1) and sum(used.values()) == sum(sizes)
    assert sorted((d, s + k) for d, s, n, *_ in pieces for k in range(n)) == [(i, k) for i, n in enumerate(sizes) for k in range(n)]


def test_fill():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        total, chosen = packing.fill(counts, 40)
        best = {0}
        for k, n in counts.items():
            best = {b + j * k for b in best for j in range(n + 1) if b + j * k <= 40}
        assert total == max(best) == sum(k * n for k, n in chosen.items()) and all(n <= counts[k] for k, n in chosen.items())


def test_wavelet(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    wavelet.write_shards(docs, folder, _tokenizer("word_bpe_49k.json"), shard_tokens=1000, partitions=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in wavelet.read_shards(spark, folder).collect())
    rows = sorted(given(docs))
    want, start = [], 0
    for (i, _), x in zip(rows, _ids("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        want.append((i, start, len(x), x.tobytes()))
        start += len(x)
    assert got == sorted(want)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == spark.read.parquet(folder).count() >= 3  # a file per shard
    ids = {i: np.frombuffer(x, "<u4").tolist() for i, _, _, x in want if i != 99}
    some = [1, 320, 49407]
    places = sorted((t, i, k) for t in some for i, x in ids.items() for k in range(len(x)) if x[k] == t)
    assert sorted(tuple(r) for r in wavelet.occurrences(spark, folder, some).where("doc_id <> 99").collect()) == places
    assert {r.token: r.n for r in wavelet.counts(spark, folder, some).collect()} == {t: sum(np.frombuffer(x, "<u4").tolist().count(t) for *_, x in want) for t in some}
    wavelet.write_shards(docs.limit(0), f"{folder}-none", _tokenizer("word_bpe_49k.json"))
    assert wavelet.read_shards(spark, f"{folder}-none").count() == 0


@pytest.mark.parametrize(("top", "n"), [(50, 999), (1, 1), (70_000, 20_000), (2, 1536), (3, 0)])
def test_wavelet_lookup(top, n):
    ids = np.random.default_rng(1).integers(0, top, n)
    m = wavelet.WaveletMatrix(wavelet.encode(ids, np.array([1]), np.array([n])))
    places = np.arange(0, n, 7)
    assert m.all().tolist() == ids.tolist() and m.access(places).tolist() == ids[places].tolist()
    # A bit per id and plane and a sixteenth of it for the counts, but for the last block.
    assert m.nbytes <= m.bits * (n / 8 * 17 / 16 + 80)
    for token in (0, 7, 49, 50, 1 << 20, *ids[:3].tolist()):
        where = np.flatnonzero(ids == token).tolist()
        assert m.select(token).tolist() == where and m.select(token, [len(where), 0, -1]).tolist() == [-1, where[0] if where else -1, -1]
        assert m.rank(token) == len(where) and m.rank(token, n // 2) == sum(w < n // 2 for w in where)


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=6)], "v", 1) for i in range(300)] + [(1000, rows0, "v", 1) for rows0 in ([0.5] * 6, None, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(1050 + i, [0.25] * 6, "v", 1) for i in range(8)] + [(None, [1.0] * 6, "v", 1), (50, [0.75] * 6, "v", 1), (50, [0.75] * 6, "v", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, score int")
    got = sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0", k=5, shard_rows=64, query_block=4).collect()))
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, qv) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for j, (i, v) in enumerate(whole) if j != at)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id = 0").count() == 0


def test_max_score_probes_less_than_it_scores():
    """Bounds that differ by term: most products of the weak terms are never taken, and the answers are exact."""
    r = np.random.default_rng(8)
    values = np.floor(r.normal(size=(8192, 32)) * 256 / np.arange(1, 33) ** 1.5).astype(np.int64)
    shard = topk.Shard(np.arange(8192), np.arange(8192), values)
    for own in range(0, 8192, 1024):
        scores = values @ values[own]
        want = sorted(((int(s), i) for i, s in enumerate(scores) if i != own), key=lambda x: (-x[0], x[1]))[:5]
        assert shard.best(values[own], own, 5) == want


PII = [
    "mail a.b@c-d.org, +1 (578) 555-6437; 4111 1111 1111 1111 and 10.0.0.255 or 10.0.0.256",
    "john (at) example [dot] com, jоhn@exаmple.com",
    "call plus one five five five two three four five six seven now",
    "john.doe at example dot com; the dot at the end of one line",
    "4111 1111 1111 1l11 and １９２.168.1.1",
    "x +1 (578) 555-6437 4111111111111111 y",
]


def test_pii(spark, docs):
    rows = [(i, t) for i, t in enumerate(PII)] + [(50, None), (51, "")]
    got = {r.doc_id: tuple(r)[1:] for r in pii.digest(pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {i: pii.digest_of(t) for i, t in rows}
    assert [got[i][:4] for i in (0, 1, 50)] == [(1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    found = [[PII[i][a:b] for _, a, b in pii.all_spans(PII[i])[1]] for i in range(1, 6)]
    assert found == [["john (at) example [dot] com", "jоhn@exаmple.com"], ["plus one five five five two three four five six seven"], ["john.doe at example dot com"], ["１９２.168.1.1", "4111 1111 1111 1l11"], ["4111111111111111", "+1 (578) 555-6437"]]
    assert pii.find_personal(docs).count() == len(given(docs))


def _brute_base(text):
    """The base patterns as the contract spells them."""
    found = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_pii_base_patterns():
    r = random.Random(21)
    parts = ["a", "b.c", "@", "@", ".", "-", "_", "+", " ", "1", "12", "255", "256", "0", "00", ".1", "4111111111111111", "(", ")", "%", "x@y.z", "é"]
    for _ in range(30_000):
        text = "".join(r.choices(parts, k=r.randint(1, 16)))
        assert pii.base_spans(text) == _brute_base(text), text


def test_pii_awkward_texts_in_linear_time():
    n = 1_000_000
    for text in ("0" * 5000 + "1.1.1.1", "x" * n + " @", "1" * n, "x@" * (n // 2), "a@b." * (n // 4), "1." * (n // 2), "+1 " * (n // 3), "+1" + " " * n, "1 " * (n // 2), "O0" * (n // 2), "l1 " * (n // 3), "one " * (n // 4), "at dot " * (n // 8), "(" * n, "[ at " * (n // 5), "а" * n, "x" * n + " at y dot com"):
        start = time.perf_counter()
        pii.all_spans(text)
        assert time.perf_counter() - start < 12, text[:10]
    assert _cut("0" * 5000 + "1.1.1.1") == [] and pii.base_spans("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)]


def _cut(text):
    return [text[a:b] for _, a, b in pii.all_spans(text)[1]]


def test_pii_letters_apart_from_digits():
    assert _cut("call +1 555 OOO 1234") == ["+1 555 OOO 1234"]
    assert _cut("card 4111 1111 llll 1111 here") == ["4111 1111 llll 1111"]
    assert _cut("host 1O.0.0.1, or 192.16.O.l") == ["1O.0.0.1", "192.16.O.l"]
    assert _cut("write john.doe at example\tdot\tcom") == ["john.doe at example\tdot\tcom"]
    assert _cut("+1 ſix ſix FİVE five nıne two three four ſix ſix") == ["+1 ſix ſix FİVE five nıne two three four ſix ſix"]
    assert _cut("version 1.0.0.1, oil or lol 12 ill.") == []


def test_pii_hint_misses_nothing(monkeypatch):
    r = random.Random(11)
    parts = ["+1 555 OOO 1234", "4111 1111 llll 1111", "1O.0.0.1", "l.2.3.4", "plus", "one", "Five,", "ſix", "nıne", "at", "dot", "com", "example", "(at)", "[dot]", "jоhn", "²", "\xad", "О", "12", "3", "4111", "OO", "l", "(", ")", ".", "-", "_", "of", "Il", "été"]
    texts = ["".join(x + r.choice(["", " ", " ", "\t", "\n", "-", ", "]) for x in r.choices(parts, k=r.randint(1, 14))) for _ in range(20_000)]
    texts += [r.choice(["one ", "ſix ", "nıne-", "SİX\n"]) * r.randint(6, 12) for _ in range(200)]
    got = [pii.all_spans(t) for t in texts]
    monkeypatch.setattr(pii, "_hinted", lambda t: True)
    assert got == [pii.all_spans(t) for t in texts]
    assert sum(len(added) for _, added in got) > 1000


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>x</ul></nav>{}<article><h1>A &amp; B</h1><p>one\n two<b>x</b></p><script>var t='</p>'</script><div class='comments'><p>me too</p></div></article><footer>f</footer></body></html>"
    rows = [(1, "http://h.org/a/1", page.format("<div>Site line</div>")), (2, "http://h.org/a/2", page.format("<div>Site line</div><p>own &lt;")), (3, "http://other.org/", page.format("<div>Site line</div>")), (4, None, None), (4, None, ""), (None, "x", "<p>a<br>b")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_diff.extract(df).collect()}
    assert got[1, rows[0][1]] == ("A & B one twox", 14)
    assert got[2, rows[1][1]][0] == "own < A & B one twox"
    assert got[3, rows[2][1]][0] == "Site line A & B one twox"
    assert got[4, None] == ("", 0) and got[None, "x"][0] == "a b"
    assert html_diff.extract(df).count() == len(rows)
    assert html_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _plain_pages(r, hosts):
    """Pages of plain divs: lines of the site around own ones; among them copies, near copies and thin pages."""
    rows, n = [], 0
    for h in range(hosts):
        menu = [f"menu {h} {i}" for i in range(r.randint(2, 5))]
        foot = [f"foot {h} {i}" for i in range(r.randint(1, 3))]
        for _ in range(r.choice([1, 2, 3, 9, 14])):
            own = [f"own {n} {i}" for i in range(r.choice([1, 4, 9]))]
            for _ in range(r.choice([1, 1, 1, 2, 4])):
                near = list(own)
                if r.random() < 0.5:
                    near[r.randrange(len(near))] = f"changed {n}"
                url = f"http://h{h}.org/{r.choice('abc')}/{r.choice('xyz')}/{r.choice([n, n, n % 3])}"
                rows.append((n, url, "".join(f"<div>{x}</div>" for x in [*menu, *near, *foot])))
                n += 1
    return rows


def _brute_html(rows):
    """Every page against the pages of its host, taken from a sorted list."""
    text, order = {}, {}
    for _, url, page in rows:
        _, _, host, path = url.split("/", 3)
        k = host, page
        order[k] = min(order.get(k, "~"), f"/{path}")
    for i, url, page in rows:
        host = url.split("/")[2]
        units = sorted((p, hashlib.md5(x.encode()).hexdigest(), x) for (h, x), p in order.items() if h == host)
        at = [x for _, _, x in units].index(page)
        mine = re.findall("<div>(.*?)</div>", page)
        gone, met, asked, d = set(), None, 0, 1
        while at - d >= 0 or at + d < len(units):
            near = [units[x] for x in (at - d, at + d) if 0 <= x < len(units)]
            near.sort(key=lambda u: -next((k for k, (x, y) in enumerate(zip(u[0], units[at][0])) if x != y), min(len(u[0]), len(units[at][0]))))
            settled = False
            for _, _, other in near:
                found, asked = html_diff.shared(mine, re.findall("<div>(.*?)</div>", other)), asked + 1
                if len(found) <= 0.8 * len(mine):
                    gone, settled = found, True
                    break
                met = found if met is None else met & found
            if settled:
                break
            d *= 2
        else:
            gone = met if asked > 1 else set()
        text[i] = " ".join(x for k, x in enumerate(mine) if k not in gone)
    return text


def test_html_differencing_decides(spark, monkeypatch):
    """Pages without a telling tag or class, against brute force over each host's pages; without the alignment the site's
    lines stay."""
    rows = _plain_pages(random.Random(12), 25)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html_diff.extract(df).collect()}
    assert got == _brute_html(rows)
    clean = [i for i, _, page in rows if got[i] == " ".join(x for x in re.findall("<div>(.*?)</div>", page) if x[:4] not in ("menu", "foot"))]
    untouched = [i for i, _, page in rows if got[i] == " ".join(re.findall("<div>(.*?)</div>", page))]
    assert len(clean) > 0.6 * len(rows) > len(untouched) + len(clean) * 0.4


def test_html_awkward_pages_in_linear_time():
    for page in ("<a '" * 250_000, "<a b" * 250_000, "<p>x" * 250_000, "<" * 1_000_000, "<a '>" * 200_000, "<!--" * 250_000, "<script>" * 125_000, "<p title=\"" * 100_000 + ">", "&lt" * 300_000, "<a href='x\"" * 90_000 + ">", "<p class='" + "ad " * 300_000 + "'>x</p>"):
        start = time.perf_counter()
        html_diff.kept_text(html_diff.lines(page), set())
        assert time.perf_counter() - start < 10, page[:10]
    words = lambda page: [x for x, _, _ in html_diff.lines(page)]
    assert words("<p>a <3 b</p><p title='>'>c</p><!-- <p>no --><?x y?>d</br>e<") == ["a <3 b", "c", "d", "e<"]
    assert words("<p>a</p><p title='b>c</p><p>d</p>") == ["a", "c", "d"]
    assert words("<b>a</b>b<SCRIPT>x</p></Script >c<textarea>no</textarea>d<style>p{}") == ["abc", "d"]


def test_shared_lines():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_diff.shared(a, b)) == table[-1][-1]


def test_toxicity(spark):
    r = random.Random(7)
    plain = ["".join(r.choice("aeioudnrst") for _ in range(r.randint(3, 7))) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            words.insert(r.randrange(40), r.choice(["grumpf", "blorkhead"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad), 1))
    rows += [(1000, "dnesa blorkh34d tio"), (1001, "dnesa g r u m p f tio"), (1002, "dnesa grrrumpf tio"), (1003, None), (1004, ""), (1004, ""), (None, "grumpf")]
    docs = spark.createDataFrame([(*x, 5.0) for x in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004)] == [1, 1, 1, 0, 0]
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0


def _decoded(token, model):
    """The best log probability over all paths of the lattice, state by state in a dict."""
    states = {"": 0.0}  # the letters of the word so far, whole, so that nothing is merged that differs
    before = ""
    for c in token:
        now = {}
        apart = c in toxicity.PUT_IN or c.isspace()
        for word, p in states.items():
            ways = [(c, toxicity.PLAIN)] if c.isalpha() else [(x, toxicity.FOR_LETTER) for x in toxicity.STANDS_FOR.get(c, "")]
            if c in toxicity.HIDDEN:
                ways += [(x, toxicity.ANY_LETTER) for x in toxicity.LETTERS if x not in [y for y, _ in ways]]
            step = lambda x, word=word: model[tuple(0 if k == "^" else ord(k) - 96 for k in ("^^" + word)[-2:]) + (0 if x == "$" else ord(x) - 96,)]
            offers = [(word + x, p + cost + step(x)) for x, cost in ways]
            if apart:
                offers.append((word, p + toxicity.PUT))
                if word:
                    offers.append(("", p + toxicity.ENDS + step("$")))
            elif not c.isalpha():
                offers.append((word, p + toxicity.ODD))
            elif c == before:
                offers.append((word, p + toxicity.AGAIN))
            for w, q in offers:
                now[w] = max(q, now.get(w, -np.inf))
        states = now
        before = before if apart else c
    end = lambda w: model[tuple(0 if k == "^" else ord(k) - 96 for k in ("^^" + w)[-2:]) + (0,)] if w else 0.0
    return max(p + end(w) for w, p in states.items())


def test_restore():
    r = random.Random(17)
    words = ["".join(r.choice("abcdeilost") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["blorkhead", "grumpf"]
    model = toxicity.char_model(toxicity.trigrams(" ".join(words)), ["blorkhead", "grumpf"])
    assert abs(float(np.exp(model).sum(axis=2)[0, 0]) - 1) < 0.05
    for _ in range(400):
        token = "".join(r.choice("abelost140@!.-_ ab*") for _ in range(r.randint(1, 9)))
        if token.count("*") + token.count("_") <= 2:
            assert abs(toxicity.restore(token, model)[1] - _decoded(token, model)) < 1e-6, token
    for token, want in (("bl0rkh3ad", ["blorkhead"]), ("g.r.u.m.p.f", ["grumpf"]), ("g r u m p f", ["grumpf"]), ("grrrruuumpf", ["grumpf"]), ("gr*mpf", ["grumpf"]), ("жgrumpf", ["жgrumpf"])):
        assert toxicity.restore(token, model)[0] == want
    assert toxicity.Scorer({"grumpf": 3.0}, model, (1, 0)).evidence("so g r u m p f and GRUMPF, so") == 4.5
    # Ways that meet early are settled early; the result is that of one piece.
    long = "".join(r.choice(["bl0rkhead", "ab1e.", "co-st", "s0", "l**t"]) for _ in range(500))
    got, p = toxicity.restore(long, model)
    parts = [toxicity.restore(long[:i], model)[1] for i in (100, 500)]
    assert np.isfinite(p) and p < parts[1] < parts[0] and len("".join(got)) > 1000


def test_toxic_awkward_texts_in_linear_time():
    model = toxicity.char_model(toxicity.trigrams("some words of a corpus"), ["grumpf"])
    scorer = toxicity.Scorer({"grumpf": 3.0}, model, (1.0, 0.0))
    for text in ("a" + "-" * 60_000 + "bc", "a " * 20_000, "a4" * 20_000, "x*" * 5_000, "word " * 400_000, "1" * 1_000_000, "é" * 20_000, "." * 1_000_000, "(" * 100_000 + "x"):
        start = time.perf_counter()
        scorer.score(text)
        assert time.perf_counter() - start < 20, text[:10]


def test_mixing(spark):
    r = random.Random(3)
    kinds = {"good": "pleasant words of prose", "poor": "BUY!! NOW!! $$$ %%% ###", "toxic": "you horrible creature there"}
    rows, marks = [], []
    for i in range(900):
        d = r.choice(["good", "good", "good", "poor", "toxic"])
        rows.append((i, " ".join(r.choice(kinds[d].split()) for _ in range(r.randint(5, 60)))))
        marks += [(i, int(d != "poor"), int(d == "toxic"))] if i % 2 else []
    rows += [(None, "words"), (2000, None), (2001, ""), (2002, "of prose " * 9000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, tokens int")
    out = mixing.mix_by_labels(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), weights=(0.6, 0.3, 0.1))
    got = out.toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["doc_id", "text", "tokens", "p_good", "p_poor", "p_toxic", "rate", "copies"]
    p, tokens = got[["p_good", "p_poor", "p_toxic"]].to_numpy(), got.tokens.to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-6) and (got.rate >= 0).all()
    assert np.allclose((got.rate * tokens) @ p / tokens.sum(), [0.6, 0.3, 0.1], atol=0.002)
    # The same descent in one process.
    rate, back = np.ones(len(p)), np.linalg.pinv(p.T @ (p * tokens[:, None]), rcond=1e-9)
    for _ in range(mixing.STEPS):
        error = (rate * tokens) @ p - np.array([0.6, 0.3, 0.1]) * tokens.sum()
        if np.abs(error).max() <= mixing.CLOSE * 0.6 * tokens.sum():
            break
        rate = np.maximum(0, rate - p @ (back @ error))
    assert np.allclose(rate, got.rate, atol=1e-6)
    assert (np.abs(got.copies - got.rate) < 1).all()
    assert mixing.mix_by_labels(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def _totals(members, moves):
    rows = members.select("tokens", "p", mixing.rate_of(F.col("p"), moves).alias("r")).toPandas()
    p = np.array(rows.p.tolist())
    return (rows.r * rows.tokens).to_numpy() @ p / rows.tokens.sum(), rows, p


@pytest.mark.parametrize("shares", [(0.5, 0.4, 0.1), (0.2, 0.7, 0.1), (0.1, 0.2, 0.7)])
def test_mixing_meets_targets_beyond_the_first_steps(spark, shares):
    """Soft posteriors far from the targets: most rates are clipped at 0."""
    r = np.random.default_rng(5)
    logs = np.eye(3)[r.choice(3, 3000, p=shares)] * 2 + r.normal(size=(3000, 3)) * 2
    p = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(r.integers(1, 500, 3000), p, strict=True)], "tokens long, p array<double>")
    total = members.agg(F.sum("tokens")).first()[0]
    moves = mixing.fit_rates(members, [w * total for w in mixing.WEIGHTS])
    assert np.abs(_totals(members, moves[: mixing.STEPS])[0] - mixing.WEIGHTS).max() > mixing.CLOSE
    assert np.abs(_totals(members, moves)[0] - mixing.WEIGHTS).max() <= mixing.CLOSE * 0.85


def test_mixing_warns_of_targets_out_of_reach(spark):
    """All posteriors between 0.2 and 0.6: the rated totals are the closest, by the conditions of the optimum."""
    r = np.random.default_rng(6)
    p = 0.2 + 0.4 * r.dirichlet([1, 1, 1], 500)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(r.integers(1, 500, 500), p, strict=True)], "tokens long, p array<double>")
    total = members.agg(F.sum("tokens")).first()[0]
    with pytest.warns(UserWarning, match="no rates reach the targets"):
        moves = mixing.fit_rates(members, [w * total for w in mixing.WEIGHTS])
    got, rows, p = _totals(members, moves)
    pull = p @ (got - mixing.WEIGHTS)
    assert pull.min() > -1e-3 and np.abs(pull[rows.r > 0]).max() < 1e-3 and np.isfinite(rows.r).all()

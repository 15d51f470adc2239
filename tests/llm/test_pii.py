"""Personal data against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from sparkgauge.llm import pii

from .data import ROWS, frame, texts
from .test_documents import by_id, lower

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = [
    (50, "a@b.c.@d.e x..y@z.co.uk, @x.y a@b a@@b.cc a@b.c-@d", "s", "x"),
    (51, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 999999.1.1.1 1.2.3 1..2.3.4", "s", "x"),
    (52, "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 1 2 3 49927398716 79927398713000000000", "s", "x"),
    (53, "+1-800-555-0199 +12 345 ++44 20 7946 0958) +123456789 (+1 (2) 3.4-5 6 7 8 9", "s", "x"),
    (54, "é🙂 ñ a@b.io ü 10.0.0.1🙂+49 30 123456", "s", "x"),
    (55, "9" * 20000 + " " + "a" * 20000 + "@" + "1 " * 10000, "s", "x"),
]


def ok(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(t):
    return [[(m.start(), k, m.end()) for m in re.finditer(p, t or "") if len(m[0]) < 4000 and ok(name, m[0])] for k, (name, p) in enumerate(RE.items())]


def test_base(spark):
    rows = [(a + 100, b, c, d) for a, b, c, d in texts("/root/testdata/sf0.01") if re.search("[0-9]", b)] + ROWS + MORE
    got = by_id(pii.find_pii(frame(spark, rows)))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        if i == 55:
            assert (got[i].n_email, got[i].n_ip, got[i].n_card) == (0, 0, 0)
            continue
        want = brute(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, want)), (i, t)
        text = ",".join(f"{list(RE)[k]}:{a}:{z}" for a, k, z in sorted(sum(want, [])))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_bootstrap_finds_unseen(spark):
    rows = [(i, f"please mail user{i}@x.example.com today", "s", "x") for i in range(30)]
    rows += [(100 + i, f"please mail user{i}(at)x.example.com today", "s", "x") for i in range(3)]
    rows += [(200 + i, f"the year model{i}900x was fine", "s", "x") for i in range(10)]
    got = by_id(pii.find_pii(frame(spark, rows)))
    assert got[100].spans == "id:12:33" or got[100].spans.startswith("id:12:")
    assert all(got[200 + i].spans == "" for i in range(10))


def test_redact(spark):
    out = pii.redact(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "source", "n_words"]
    got = by_id(out)
    assert got[7].text == "mail [EMAIL] or [PHONE] from [IP] with [CARD] now"
    assert all(got[i].text == t for i, t, *_ in ROWS if i not in (7,))


def test_contexts_of_every_value(spark):
    rows = ROWS + MORE[:-1] + [(60, "badge AB123456 CD234567 EF345678", "s", "x"), (61, "2024-01-15 12345678 x\n  (GH456789).\r\n\tIJ567890 KL678901\x0bMN789012\x0c\U0001f642 é12345, short1 x", "s", "x"), (62, "9" * 3000 + " x" * 3000 + " OP890123", "s", "x")]
    got = {r.doc_id: r.c or [] for r in pii.with_contexts(frame(spark, rows), F.coalesce("text", F.lit("")), "c").collect()}
    for i, t, *_ in rows:
        words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        value = [len(w) >= 6 and bool(re.search("[0-9]", w)) for _, w in words]
        shown = ["<value>" if v else w.lower() for v, (_, w) in zip(value, words, strict=True)]
        want = []
        for k, (a, w) in enumerate(words):
            if not value[k]:
                continue
            inner = re.sub(pii.TRAIL, "", re.sub(pii.LEAD, "", w))
            a += len(re.match(f"(?:{pii.LEAD[1:]})?", w)[0])

            def take(side):  # up to two words, ended by a value or the text's end
                out = []
                for x in side:
                    out.append(x)
                    if x == "<value>" or len(out) == 2:
                        break
                return out if len(out) == 2 or out[-1:] == ["<value>"] else [*out, "<edge>"]

            b, z = take(shown[:k][::-1])[::-1], take(shown[k + 1 :])
            both = [" ".join([*b, "_"]), " ".join(["_", *z]), f"{b[-1]} _ {z[0]}"]
            keep = [p if len(p) <= 64 else hashlib.md5(p.encode()).hexdigest() for p in both if p not in ("<edge> _", "_ <edge>", "<edge> _ <edge>")]
            want.append((a, a + len(inner), inner, keep))
        assert [(c.start, c.stop, c.value, c.patterns) for c in got[i]] == want, i


def test_runs_of_identifiers_are_found_whole(spark):
    rows = [(i, f"badge user{i}@x.example.com\nuser{i}@x.example.com user{i + 1}@x.example.com", "s", "x") for i in range(30)]
    rows += [(100, "user5(at)x.example.com", "s", "x"), (101, "badge user5(at)x.example.com\nuser6(at)x.example.com", "s", "x")]
    got = by_id(pii.find_pii(frame(spark, rows)))
    assert got[100].spans == "" and got[101].spans == "id:6:28,id:29:51"  # a value alone has no context


def test_words_that_are_no_identifiers_keep_a_context_untrusted(spark):
    rows = [(i, f"order number {10000000 + 7 * i} for user{i}@x.example.com", "s", "x") for i in range(40)]
    rows += [(100 + i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is set', "s", "x") for i in range(9)] + [(200, 'token = "hunter22" is set', "s", "x")]
    got = by_id(pii.find_pii(frame(spark, rows)))
    assert all("id" not in got[i].spans for i in range(40))
    assert got[200].spans == "id:9:17" and all(got[100 + i].spans == "id:9:49" for i in range(9))


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 101):
        x = list(range(n))
        assert spark.range(1).select(pii.running(F.array(*map(F.lit, x)).cast("array<int>"))).first()[0] == [sum(x[: k + 1]) for k in range(n)]

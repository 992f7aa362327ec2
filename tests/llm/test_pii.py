import re
from math import prod

from tradewind.llm import pii as P
from tradewind.llm.queries import op6_personal_data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == 0, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), kind == 2 and 12 <= len(d) <= 19 and luhn(d), kind == 3 and 9 <= len(d) <= 15)[kind]:
                found.append((m.start(), kind, m.end(), m[0]))
    return sorted(found)


TEXTS = [
    None, "", "a@b.c", "x a@b.c_d@e.f.. g@h", "a@b.c@d.e", "\U0001f600é a.b+c@d-e.f-g.h, 1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 001.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000 0000 0000 1  2", "+1 (487) 555-7209 +1 2 +49 (0) 30 123456. ++12345678901 +123456789012345678", "9" * 30_000, "a." * 20_000 + "@b.c" + ".a" * 20_000,
    "1.1.1.1" * 2_000, "1 " * 30_000, "\n+1-487-555-7209\n4644348398010899\n", "٣٤٥ 4111 1111 1111 1111 1", "a@b@c.d", "99999999999999999999.1.1.1", "x" * 100_000 + "@",
]


def test_base_spans_match_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in df.selectExpr("doc_id", "coalesce(text, '') as text").select("doc_id", P.base_spans("text").alias("base")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in op6_personal_data(spark, "/root/testdata/sf0.01").collect():
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert {f"{P.KINDS[k]}:{a}:{b}" for a, k, b, _ in base} <= set(r.spans.split(","))


def contexts():
    rows = [(k, f"please call me at +1 (555) 010-{1000 + k} today") for k in range(6)]
    return rows + [(10, "please call me at 555010-77777 today"), (11, "the year was 20012002 or so"), (12, "call me at number 12345678")]


def test_patterns_find_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(contexts(), "doc_id long, text string")).collect()}
    assert [tuple(s) for s in rows[10].spans] == [(18, 3, 30, "555010-77777")] and not rows[10].base
    assert not rows[11].spans and not rows[12].spans
    assert all(len(rows[k].spans) == 1 for k in range(6))


def test_odd_rows_and_redaction(spark):
    rows = [*contexts(), (None, "a@b.c"), (None, None), (1, "same 1.2.3.4 +1 (487) 555-7209"), (1, "same 1.2.3.4 +1 (487) 555-7209"), (20, "1.2.3.4@b.cd")]
    df = spark.createDataFrame([(*r, "x", "y", 2) for r in rows], "doc_id long, text string, sha string, base string, kind int")
    got = P.personal_data(df).collect()
    assert len(got) == len(rows)
    red = P.redact(df)
    assert red.columns == df.columns
    texts = sorted((r.doc_id or -1, r.text or "") for r in red.collect())
    assert texts.count((1, "same <ip> <phone>")) == 2 and texts.count((1, "please call me at <phone> today")) == 1
    assert (10, "please call me at <phone> today") in texts and (20, "<email>") in texts and texts.count((-1, "<email>")) == texts.count((-1, "")) == 1
    assert P.personal_data(df.limit(0)).collect() == P.redact(df.limit(0)).collect() == []


def brute_members(rows):
    """The loop of members() in plain Python, over (doc, text)."""
    edges, own = {}, {}
    for _, text in rows:
        base = brute(text)
        spans = [(a, b, k, t) for a, k, b, t in base]
        for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text):
            t = m[0]
            if ("@" in t or len(re.sub("[^0-9]", "", t)) >= P.DIGITS) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                spans.append((m.start(), m.end(), -1, t))
        piece = r"\(?[0-9]+\)?(?:[.-][0-9]+)*"
        for m in re.finditer(rf"(?<!\S)\+?{piece}(?: {piece})+(?=[.,;:!?]*(?:\s|$))", text):
            if P.DIGITS <= len(re.sub("[^0-9]", "", m[0])) <= P.MOST and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                spans.append((m.start(), m.end(), -1, m[0]))
        for a, b, k, t in spans:
            left = re.search(r"(?:^|\s)(\S+\s+\S+)\s*$", text[:a])
            right = re.search(r"""^[.,;:!?)\]"']*\s+(\S+\s+\S+)(?:\s|$)""", text[b:])
            # Whole words within NEAR characters, and the blank that ends them if the text goes on.
            left = left if left and (a <= P.NEAR or left.start() >= a - P.NEAR) else None
            right = right if right and (len(text) - b <= P.NEAR or right.end() <= P.NEAR) else None
            own[t] = max(k, own.get(t, -1))
            for side, m in (("<", left), (">", right)):
                if m:
                    edges.setdefault(side + re.sub("[0-9]+", "0", m[1].lower()), set()).add(t)
    known = {t: k for t, k in own.items() if k >= 0 and any(t in x for x in edges.values())}
    seeds = set(known)
    while True:
        sure = {}
        for p, tokens in edges.items():
            kinds = [known.get(t) for t in tokens]
            every = sum(k is not None for k in kinds) + P.UNKNOWN * kinds.count(None)
            for k in range(4):
                if kinds.count(k) >= P.MEMBERS and kinds.count(k) / every >= P.CONFIDENT:
                    sure[p, k] = kinds.count(k) / every
        fresh = {}
        for t in own.keys() - known.keys():
            c = [(1 - prod(max(1 - v, 1e-6) for (p, k), v in sure.items() if k == kind and t in edges[p]), -kind) for kind in range(4)]
            if max(c)[0] >= P.CONFIDENT:
                fresh[t] = -max(c)[1]
        if not fresh:
            break
        known |= fresh
    return {t: k for t, k in known.items() if t not in seeds}


def hops():
    """Identifiers found by one pattern induce a second one, and those of the second a third, behind the identifier."""
    rows = [(k, f"please call me at +1 (555) 010-{1000 + k} today or so") for k in range(6)]
    rows += [(10 + k, f"please call me at 55501077{k} then wait") for k in range(4)]
    rows += [(20 + k, f"her desk line is 55501077{k} you know") for k in range(4)] + [(25, "her desk line is 888777666 you see")]
    rows += [(30 + k, f"try 55501077{k} during office hours") for k in range(4)] + [(35, "dial 444333222 during office hours"), (36, "the year 19992000 was long"), (37, "nobody dials 444333222.")]
    return rows


def test_a_chain_of_hops_is_followed_to_its_end(spark):
    """Each hop's identifiers come with the pattern before theirs and with one of their own."""
    names = [f"n{chr(97 + k)}" for k in range(14)]
    rows = [(k, f"begin with na at +1 (555) 010-{1000 + k} end") for k in range(4)]
    for hop in range(12):
        for k in range(3):
            number = f"7{hop:02}{k}5550"
            rows += [(0, f"begin with {names[hop]} at {number} end" if hop == 0 else f"it {names[hop]} at {number} end"), (0, f"it {names[hop + 1]} at {number} stop")]
    known = brute_members(rows)
    assert len(known) == 36
    found = P.occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.token: r.kind for r in P.members(found).collect()} == known


def test_identifiers_in_several_words(spark):
    rows = [(k, f"please call me at +1 (555) 010-{1000 + k} today or so") for k in range(6)]
    rows += [(10, "please call me at 555 010 7788, today or so"), (11, "please call me at (555) 010-77.88 today"), (12, "x " + "1 " * 20_000 + "x"), (13, "please call me at 1 2 3 today"), (14, "again 555 010 7788"), (15, "no 555 010 7788x")]
    got = {r.doc_id: [s.token for s in r.spans if s not in r.base] for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == got[14] == ["555 010 7788"] and got[11] == ["(555) 010-77.88"] and not got[12] and not got[13] and not got[15]
    assert {r.token: r.kind for r in P.members(P.occurrences(spark.createDataFrame(rows[:12] + rows[13:], "doc_id long, text string"))).collect()} == brute_members(rows[:12] + rows[13:])


def test_words_are_not_cut(spark):
    long = "y" * 100
    rows = [(0, f"{long} at 123456789 {long} z"), (1, f"a {long} 123456789"), (2, f"b {'y' * 70} c 987654321 d {'y' * 70} e"), (3, f"{'y' * 74} at 55555 {'y' * 74} at")]
    around = {r.doc: [list(s.around) for s in r.other] for r in P.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert around == {0: [["", ""]], 1: [["", ""]], 2: [[f"<{'y' * 70} c", f">d {'y' * 70}"]], 3: [[f"<{'y' * 74} at", f">{'y' * 74} at"]]}


def test_discoveries_induce_patterns(spark):
    rows = hops()
    got = {r.doc_id: [tuple(s)[1:] for s in r.spans if s not in r.base] for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[25] == [(3, 26, "888777666")] and got[35] == [(3, 14, "444333222")]
    assert all(len(got[k]) == 1 for k in (10, 13, 20, 23, 30, 33)) and not got[36] and not got[37]
    known = brute_members(rows)
    found = P.occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.token: r.kind for r in P.members(found).collect()} == known and len(known) == 6


def test_members_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert {r.token: r.kind for r in P.members(P.occurrences(docs)).collect()} == brute_members(texts)

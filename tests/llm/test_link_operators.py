"""Near-duplicates, components, quotations, URL lists, secrets and the pipeline."""

import random
from collections import defaultdict

import pytest

from seriata.llm import near_dup, quotes, secrets, url_lists
from seriata.llm.components import components
from tests.llm.test_text_operators import brute_set, make, prose


def brute_components(texts, ids, threshold):
    sets = [brute_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= round(100 * threshold) * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(texts))], [len(s) for s in sets]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "e" + str(rng.randrange(10**9))
    return " ".join(w)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.randint(0, 5)) for _ in range(150)]  # one large group with many pairs about the threshold
    for _ in range(40):
        t = prose(rng, rng.randint(3, 200))
        texts += [edited(rng, t, rng.randint(0, 4)) for _ in range(rng.randint(1, 4))]
    chain = [str(i) for i in range(400)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 160, 8)]  # linked only through neighbours
    texts += ["", None, "  ", "one two", "One  TWO", texts[0], texts[3].upper(), prose(rng, 6000)]
    ids = [7 * i + 3 for i in range(len(texts))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = make(spark, [texts[i] for i in order], [ids[i] for i in order]).repartition(3)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, threshold).collect()}
    want, sizes = brute_components(texts, ids, threshold)
    assert len(got) == len(texts)
    for i, d in enumerate(ids):
        assert got[d].n_shingles == sizes[i]
        assert got[d].component_id == want[i], (d, texts[i] and texts[i][:60])
        assert got[d].kept == (d == want[i])


def test_near_duplicates_edges(spark):
    assert near_dup.near_duplicates(make(spark, []), 0.85).count() == 0
    got = near_dup.near_duplicates(make(spark, ["a b c d e f", "a b c d e f", None, ""], ids=[None, 4, None, 2]), 0.85).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.n_shingles} == {4}
    same = near_dup.near_duplicates(make(spark, ["a b c d e f"] * 3, ids=[1, 1, 2]).withColumn("digest", __import__("pyspark").sql.functions.lit(1)), 0.85).collect()
    assert {r.component_id for r in same} == {1}
    kept = near_dup.drop_near_copies(make(spark, ["a b c d e f g", "a b c d e f g", "z"], ids=[9, 4, 5]), 0.8).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5]


def test_near_copies_go_by_row(spark):
    texts = ["a b c d e f g", "a b c d e f g", "quite another text of eight words here", "", None]
    kept = near_dup.drop_near_copies(make(spark, texts, ids=[1, 5, 5, 5, None]), 0.8).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, texts[0]), (5, ""), (5, texts[2])]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 120)] + [(5, 5), (None, 3)]
    rng = random.Random(0)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(120)) and len(got) == 321
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_miss_almost_nothing():
    for t in (0.8, 0.85):
        b = near_dup.bands_for(t)
        assert (1 - t**near_dup.ROWS) ** b <= 1e-6


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nIs this   THING on?"),
        (1, 1, "assistant", "On Monday Ann wrote:\n> is this thing on?\nYes, it is."),
        (1, 2, "user", "On Tuesday Bob wrote:\n> On Monday Ann wrote:\n>> Is this thing on?\n> Yes, it is.\nThanks"),
        (1, 3, "assistant", "unrelated"),
        (1, 4, "user", "> nobody said this\nreally"),
        (2, 0, "user", "> Hello there.\nother conversation"),
        (2, 1, "user", None),
        (2, 2, "user", ""),
        (2, 2, "user", ""),
        (None, None, "user", "lost"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link(conversation(spark, rows)).collect()}
    assert quotes.link(conversation(spark, rows)).count() == len(rows)
    assert got[1, 1].reply_to == 0 and got[1, 1].body == "Yes, it is."
    assert got[1, 2].reply_to == 1 and got[1, 2].deepest_quote == 2 and got[1, 2].body == "Thanks"
    assert got[1, 2].thread == 0 and got[1, 2].depth == 2
    assert got[1, 4].reply_to is None and got[1, 4].quoted_passages == 1 and got[1, 4].linked_passages == 0
    assert got[2, 0].reply_to is None and got[2, 0].body == "other conversation"
    order = [(r.thread, r.turn) for r in quotes.link(conversation(spark, rows[:5])).collect()]
    assert order == sorted(order) and order[:3] == [(0, 0), (0, 1), (0, 2)]
    assert quotes.link(conversation(spark, [])).count() == 0


def planted_messages(rng, convs=60, turns=12):
    """Messages that quote whole bodies, excerpts, lines and nested quotes of earlier ones, and things nobody said."""
    say = lambda: "\n".join(" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "ok"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 5))) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 7)))
    quote = lambda t, level=1: "\n".join(rng.choice([">" * level, "> " * (level - 1) + ">"]) + rng.choice(["", " "]) + x for x in t.split("\n"))
    rows = []
    for c in range(convs):
        said = []
        for turn in range(turns):
            body, text = say(), ""
            if said and rng.random() < 0.8:
                t = rng.choice(said)
                lines = t.split("\n")
                a = rng.randrange(len(lines))
                kind = rng.randrange(5)
                part = t if kind == 0 else "\n".join(lines[a : a + rng.randint(1, 4)]) if kind < 3 else lines[a] if kind == 3 else say()
                text = rng.choice(["", "On Monday " + "x" * rng.choice([3, 400]) + " wrote:\n"]) + quote(part.upper() if rng.random() < 0.3 else part, 1) + "\n"
                if rng.random() < 0.3:
                    text += quote(rng.choice(said), 2) + "\n"
            said.append(body)
            rows.append((c if c else None, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant"]), rng.choice([text + body, body + "\n" + text]) if rng.random() < 0.97 else None))
    return rows + rows[5:8]


def test_quotes_equal_sql_on_planted_messages(spark):
    import duckdb
    import pandas as pd

    from seriata.llm.queries import ORACLES

    rows = planted_messages(random.Random(3))
    got = quotes.link(conversation(spark, rows).repartition(3)).toPandas()
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("frame", frame)
    con.sql("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from frame")
    want = con.sql(ORACLES["op5_quotation_linking"]).df()
    cols = sorted(got.columns)
    plain = lambda d: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert plain(got) == plain(want)
    assert got["linked_passages"].sum() > 300 and (got["quoted_passages"] > got["linked_passages"]).any()


def test_excerpts_and_long_marks(spark):
    rows = [
        (1, 0, "user", "one line\n\nsecond  Line\nthird line\nfourth"),
        (1, 1, "user", "On " + "x" * 5000 + " wrote:\n> second line\n> THIRD line\nanswer"),
        (1, 2, "user", "> third line\n> one line\nnot in a row"),
        (1, 3, "user", ">" * 100_000 + " deep"),
        (1, 4, "user", ("line " + "y" * 40 + "\n") * 20_000),
    ]
    got = {r.turn: r for r in quotes.link(conversation(spark, rows)).collect()}
    assert got[1].reply_to == 0 and got[1].body == "answer"
    assert got[2].reply_to is None and got[2].quoted_passages == 1
    assert got[3].deepest_quote == 100_000 and got[3].body == "" and len(got[4].body) > 900_000


def test_long_reply_chains(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    got = {r.turn: r for r in quotes.link(conversation(spark, rows)).collect()}
    assert all(got[i].thread == 0 and got[i].depth == i for i in range(40))


def test_lists_hold_in_their_intervals(spark):
    from pyspark.sql import functions as F

    entries = [("block", "bad.example", "add", "2024-01-10"), ("block", "bad.example", "remove", "2024-02-10"), ("block", "bad.example", "add", "2024-03-10"), ("allow", "good.bad.example", "add", "2024-01-20"), ("block", None, "add", "2024-01-01"), ("block", "x.example", "add", None), ("block", "twice.example", "add", "2024-01-05"), ("block", "twice.example", "remove", "2024-01-05")]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, d string").withColumn("at", F.to_date("d"))
    urls = ["http://bad.example/a", "https://u@www.bad.example:80/?q", "http://good.bad.example", "http://notbad.example", "nonsense", None, "http://x.example/", "http://twice.example/"]
    days = ["2024-01-09", "2024-01-10", "2024-02-09", "2024-02-10", "2024-03-11", None]
    rows = [(i, u, d) for i, (u, d) in enumerate((u, d) for u in urls for d in days)] * 2
    c = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("fetched_at", F.to_date("d"))
    got = url_lists.evaluate(c, e).collect()
    assert len(got) == len(rows)

    def active(d, spans):
        return d is not None and any(a <= d and (b is None or d < b) for a, b in spans)

    block, allow = [("2024-01-10", "2024-02-10"), ("2024-03-10", None)], [("2024-01-20", None)]
    clash = url_lists.evaluate(c.selectExpr("*", "'x' host", "'y' verdict", "1 rule_list", "2 pattern"), e)
    assert clash.count() == len(rows) and clash.where("verdict = 'y'").count() == 0
    for r in got:
        u = r.url or ""
        want = "allowed"
        if u.endswith("good.bad.example") and active(r.d, allow):
            pass
        elif ("/bad.example" in u or ".bad.example" in u) and active(r.d, block):
            want = "blocked"
        assert r.verdict == want, r
    assert url_lists.evaluate(c.limit(0), e).count() == 0 and url_lists.evaluate(c, e.limit(0)).where("verdict = 'blocked'").count() == 0


VOCABULARY = [a + b for a in ("tion", "ther", "ment", "sch", "ing") for b in ("ther", "sch", "ouble", "ment", "ing")] + ["alpha", "beta", "some", "words", "plain", "only", "here", "more", "picture"]


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.example_findings(spark, VOCABULARY, 5400), VOCABULARY)


def test_secrets_are_found_and_prose_left(spark, forest):
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    found = [f"some words {key()} and more", f"then password={hexa(18)} follows", f'with token = "{hexa(40)}" here']
    clean = ["plain words only here", "card 4041894974612345 and phone 49170123456789012", "see https://www.example.com/img/2024/picture12345.png now", "", None, "thetionhermentoutheranding1 more"]
    texts = found + clean
    docs = make(spark, texts)
    rows = secrets.scan(docs, forest).collect()
    hit = {r.doc_id for r in rows if r.secret}
    assert hit == {0, 1, 2}, [(r.doc_id, r.value, r.probability) for r in rows]
    redacted = {r.doc_id: r for r in secrets.redact(docs.withColumn("value", docs.lang), forest).collect()}
    assert redacted[0].text == "some words [SECRET] and more" and redacted[0].n_chars == len(redacted[0].text)
    assert all(redacted[i].text == texts[i] for i in range(3, len(texts))) and "value" in redacted[0].asDict()
    assert secrets.scan(make(spark, []), forest).count() == 0 and secrets.redact(make(spark, []), forest).count() == 0
    assert secrets.dictionary(make(spark, [])) == [] and secrets.scan(docs, secrets.train(secrets.example_findings(spark, (), 1800))).count() == len(rows)


def test_secrets_of_null_and_repeated_ids_are_redacted(spark, forest):
    key = lambda c: "AKIA" + (c + "2") * 8
    texts = [f"one {key('Z')} end", f"two {key('Q')} end", f"three {key('X')} end", f"four {key('V')} end", "plain", None]
    got = secrets.redact(make(spark, texts, ids=[None, None, 7, 7, None, 7]), forest).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "one [SECRET] end"), (0, "plain"), (0, "two [SECRET] end"), (7, ""), (7, "four [SECRET] end"), (7, "three [SECRET] end")]
    again = secrets.redact(make(spark, texts[:1] * 3, ids=[4, 4, 5]), forest).collect()  # repeated rows stay, each redacted
    assert [r.text for r in again] == ["one [SECRET] end"] * 3


def test_only_the_found_place_is_redacted(spark, forest):
    class Named:
        """Says yes to assigned values only."""

        def transform(self, rows):
            from pyspark.ml.functions import array_to_vector
            from pyspark.sql import functions as F

            return rows.withColumn("probability", array_to_vector(F.array(1 - F.col("assigned"), F.col("assigned"))))

    model = secrets.SecretModel(Named(), (), {})
    text = "password=tiger9 and the tiger9 cub, tiger90 too\x01 a\x02\x0b b\x0b"
    [r] = secrets.redact(make(spark, [text, ][:1]), model).collect()
    assert r.text == text.replace("password=tiger9 ", "password=[SECRET] ")


RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
SPACE = " \t\n\x0b\f\r"


def assigned_before(text, i):
    """Whether text[:i] ends in a name, a colon or equals sign, and perhaps blanks and a quote."""

    def name_ends(j):
        j2s = {j}
        for k in range(1, 4):
            if j - k >= 0 and text[j - k] in " \t":
                j2s.add(j - k)
            else:
                break
        ends = set()
        for q in j2s:
            ends |= {q} | ({q - 1} if q and text[q - 1] in "\"'" else set())
        names = ["password", "passwd", "pwd", "secret", "token", *[a + x + b for a, b in (("api", "key"), ("access", "key")) for x in ("", "-", "_")]]
        return any(text[:e].lower().endswith(n) for e in ends for n in names)

    for quote in (0, 1):
        j = i - quote
        if quote and (j < 0 or text[j] not in "\"'"):
            continue
        for blanks in range(4):
            if j - blanks < 0 or any(c not in " \t" for c in text[j - blanks : j]):
                break
            at = j - blanks
            if at and text[at - 1] in ":=" and name_ends(at - 1):
                return True
    return False


def brute_candidates(text):
    """(start, end) of the candidates, one character after the other."""
    out, i = [], 0
    text = "".join("\x0b" if c in "\x01\x02" else c for c in text or "")
    while i < len(text):
        end = None
        if assigned_before(text, i):
            j = i
            while j < len(text) and text[j] not in SPACE + "\"',;":
                j += 1
            end = j if j - i >= 6 else None
        if end is None and text[i] in RUN and (i == 0 or text[i - 1] not in RUN):
            j = i
            while j < len(text) and text[j] in RUN:
                j += 1
            if j - i >= 16 and any(c in "0123456789" for c in text[i:j]):
                end = j
        if end is None and text[i : i + 4] == "AKIA" and len(text) >= i + 20 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for c in text[i + 4 : i + 20]):
            end = i + 20
        if end:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def brute_features(value, before, after, model):
    import math
    import re

    import regex

    n = len(value)
    kind = lambda c: "a" if c in "abcdefghijklmnopqrstuvwxyz" else "A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "0" if c in "0123456789" else c
    table = secrets.transition_table(model.words)
    code = [secrets._CODES.find(c) + 1 for c in value.lower()]
    pieces = [w for w in regex.split(r"[^\p{L}]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", value).lower())]
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    glued = before.split(" ")[-1] + value + after.split(" ")[0]
    return {
        "length": n,
        "digits": sum(c in "0123456789" for c in value) / n,
        "capitals": sum(kind(c) == "A" for c in value) / n,
        "hex": sum(c in "0123456789abcdef" for c in value) / n,
        "variety": len(set(value)) / n,
        "entropy": -sum(value.count(c) / n * math.log2(value.count(c) / n) for c in set(value)),
        "transitions": sum(kind(a) != kind(b) for a, b in zip(value, value[1:])) / n,
        "likelihood": sum(table[a * secrets._N + b] for a, b in zip(code, code[1:])) / max(1, n - 1),
        "coverage": sum(len(w) for w in pieces if w in model.words) / n,
        "path": float(bool(re.search(r"(?i)[/\\][^/\\]+[/\\]|https?:|\.(html?|png|jpe?g|js|css)$", glued))),
        "before_odds": sum(model.odds.get(w, 0) for w in words(before)[-3:]),
        "after_odds": sum(model.odds.get(w, 0) for w in words(after)[:2]),
        "assigned": float(bool(re.search("[:=] ?[\"']?$", before))),
        "quoted": float(before[-1:] in ("'", '"')),
        "access_id": float(bool(re.fullmatch("AKIA[A-Z0-9]{16}", value))),
        "spaced_number": float(bool(re.fullmatch("[0-9+/_-]+", value))),
        "repeats": float(bool(re.search(r"(.)\1{4,}", value))),
    }


def test_secrets_equal_a_brute_force_scan(spark, forest):
    import re

    rng = random.Random(11)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    bits = [lambda: "AKIA" + hexa(16).upper(), lambda: "password", lambda: "Api-Key", lambda: "token", lambda: "=", lambda: ":", lambda: " ", lambda: "  ", lambda: "\n", lambda: '"', lambda: "'", lambda: "\t", lambda: hexa(rng.randint(3, 50)), lambda: "/img/" + hexa(12) + ".png", lambda: rng.choice(VOCABULARY), lambda: "Ünïcode", lambda: ",", lambda: "commit", lambda: "AKIA", lambda: "-" * rng.randint(1, 9), lambda: "\x01", lambda: "\x02", lambda: "\x0b", lambda: "7" * rng.randint(1, 20), lambda: "CamelCaseWords"]
    texts = ["".join(rng.choice(bits)() for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 5000 + hexa(30)]
    got = {(r.doc_id, r.k): r for r in secrets.candidates(make(spark, texts).repartition(3)).collect()}
    want = {}
    for d, t in enumerate(texts):
        places = brute_candidates(t)
        for k, (a, b) in enumerate(places):
            last = places[k - 1][0] if k else 0
            nxt = places[k + 1][0] if k + 1 < len(places) else len(t)
            plain = lambda x: re.split(r"[ \t\n\x0b\f\r]+", x.replace("\x01", " ").replace("\x02", " "))
            want[d, k] = (t[a:b], " ".join(plain(t[last:a])[-4:]), " ".join(plain(t[b:nxt])[:3]))
    assert {k: (r.value, r.before, r.after) for k, r in got.items()} == want and len(want) > 300
    rows = spark.createDataFrame([(r.value, r.before, r.after) for r in got.values()], "value string, before string, after string")
    for r in secrets.features(rows, forest).collect():
        own = brute_features(r.value, r.before, r.after, forest)
        assert all(abs(r[f] - own[f]) < 1e-9 for f in secrets.FEATURES), (r, own)


def test_dictionary_counts_documents(spark):
    texts = ["Alpha beta alpha", "beta, gamma! x1y", "gamma", "delta delta", None, "", "beta " + "z" * 30]
    assert secrets.dictionary(make(spark, texts)) == ["beta", "gamma"] and secrets.dictionary(make(spark, texts), 1) == ["beta"]


def test_secrets_behind_long_runs_are_found(spark, forest):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    slug = lambda n: "-".join(["tionther", "mentsch", "ingouble"] * n)
    base64 = lambda n: text(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = [slug(10) + "-" + base64(43), "chapter1-" + slug(10) + "-" + base64(43), slug(9) + base64(43) + slug(9), slug(10) + "AKIA" + text(16, "ABCDEFGHIJ234567"), "token = " + slug(60) + text(40, "0123456789abcdef")]
    clean = [slug(10), "1-" + slug(10), slug(12) + "-2", slug(400) + "24"]
    docs = make(spark, [f"words {v} more" for v in found + clean])
    rows = secrets.scan(docs, forest).collect()
    assert {r.doc_id for r in rows if r.secret} == set(range(len(found))), [(r.doc_id, r.probability) for r in rows]
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 4, 6, 7, 8]
    redacted = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert all("[SECRET]" in redacted[i] and found[i][-40:] not in redacted[i] for i in range(len(found)))
    assert all(redacted[len(found) + i] == f"words {v} more" for i, v in enumerate(clean))
    rest = [r.w for r in spark.sql(f"select '{slug(10)}{'x' * 7}9' as v").select(F.explode(secrets.windows(F.col("v"))).alias("w")).collect()]
    assert rest[-1].endswith("x9") and all(secrets.WINDOW - secrets.STEP < len(w) <= secrets.WINDOW for w in rest)


def test_native_operators_have_no_python_in_their_plans(spark, forest):
    convs = conversation(spark, [(1, 0, "user", "a"), (1, 1, "user", "> a\nb")])
    for df in (quotes.link(convs), secrets.scan(make(spark, ["AKIA" + "Z2" * 8]), forest)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from seriata.llm import quality

    rng = random.Random(8)
    good = [prose(rng, rng.randint(20, 120)) for _ in range(60)]
    texts = [*good, *good[:10], *[edited(rng, g, 1) for g in good[20:30] if len(g.split()) > 70], *[" ".join(["junk"] * 80) + " " + str(i) for i in range(30)], good[0].upper() + "", None, ""]
    docs = make(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("junk" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    d = str(tmp_path)
    one = stage["quality"](spark, docs, d)
    assert one.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(d + "/labels.parquet"))
    ids1 = {r.doc_id for r in one.collect()}
    assert ids1 == {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    two = stage["exact_dedup"](spark, one, d)
    groups = defaultdict(list)
    for i in ids1:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i] or "")].append(i)
    ids2 = {max(g) for g in groups.values()}
    assert {r.doc_id for r in two.collect()} == ids2 and two.columns == docs.columns
    three = stage["near_dedup"](spark, two, d)
    order = sorted(ids2)
    want, _ = brute_components([texts[i] for i in order], order, corpus_pipeline.NEAR)
    assert {r.doc_id for r in three.collect()} == {i for i, c in zip(order, want) if i == c} and three.columns == docs.columns
    four = stage["secrets"](spark, three, d)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} and four.columns == docs.columns
    five = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == {r.doc_id for r in four.collect()}


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(12)] + ["x " * 50] * 4 + [None]
    plain = make(spark, texts)
    extra = [c for c in ("score", "digest", "_x", "value", "rid", "id", "h", "key", "root", "probability", "features", "bucket", "klass", "y")]
    docs = plain.select("*", *[__import__("pyspark").sql.functions.lit("kept").alias(c) for c in extra])
    spark.createDataFrame([(i, int(i < 12), 0) for i in range(16)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*plain.columns, *extra], name
        assert all(r[c] == "kept" for r in docs.collect() for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_forest_holds_on_findings_it_has_not_seen(spark):
    from pyspark.sql import functions as F

    found = secrets.example_findings(spark, VOCABULARY, 7200).withColumn("fold", F.crc32(F.col("value")) % 4)
    model = secrets.train(found.where("fold != 0"), VOCABULARY)
    held = secrets.scored(found.where("fold = 0"), model).selectExpr("label", "probability >= 0.5 as yes").collect()
    hits = sum(r.yes and r.label == 1 for r in held)
    assert hits / sum(r.label == 1 for r in held) > 0.97 and hits / sum(r.yes for r in held) > 0.97


def test_pipeline_redacts_and_packs_every_id(spark, tmp_path):
    """Planted secrets, one in a row without doc_id, go through all stages; the packed ids are those of the redacted texts."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(21)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plain = [prose(rng, rng.randint(30, 90)) for _ in range(40)]
    planted = {}
    for i in range(0, 12):
        key = hexa(40)
        planted[i] = plain[i] + ' token = "[SECRET]" ' + plain[i + 1][:40]
        plain[i] = planted[i].replace("[SECRET]", key)
    junk = [" ".join(["junk"] * rng.randint(60, 90)) for _ in range(30)]
    texts = [*plain, *junk]
    ids = [None if i == 3 else i for i in range(len(texts))]
    make(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(len(texts)) if i != 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == {None if i == 3 else i for i in range(40)}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, own in by_doc.items():
        i = 3 if d is None else d
        want = np.array([*tok.encode(planted.get(i, texts[i]), add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda p: p.start)
        assert sum(p.length for p in own) == len(want), (d, texts[i])
        assert all(p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in own)


def test_very_long_texts_link_and_scan(spark, forest):
    from pyspark.sql import functions as F

    long = ["x" + " " * 2_000_000 + "y", "a" * 2_000_000, "ab " * 700_000, "0123456789abcdef" * 100_000, "w1 w2 w3 w4 w5 w6 " * 100_000]
    docs = make(spark, [*long, *long[2:3]]).repartition(6)
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs, 0.85).collect()}
    assert [near[i].n_shingles for i in range(6)] == [1, 1, 1, 1, 6, 1] and near[5].component_id == 2 and near[4].component_id == 4
    assert sorted(r.doc_id for r in near_dup.drop_near_copies(docs, 0.85).collect()) == [0, 1, 2, 3, 4]
    found = secrets.scan(docs, forest).collect()
    assert {r.doc_id for r in found} == {3} and len(found[0].value) == 1_600_000
    assert secrets.redact(docs, forest).count() == 6
    urls = ["http://bad.example/" + "p" * 2_000_000, "http://" + "a." * 200 + "bad.example/", "x" * 2_000_000, "", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched_at", F.lit("2024-05-01").cast("date"))
    lists = spark.createDataFrame([("block", "bad.example", "add", "2024-01-01"), (None, "bad.example", "remove", "2024-02-01"), ("other", "bad.example", "add", "2024-02-01")], "list string, pattern string, action string, d string").withColumn("at", F.to_date("d"))
    got = {r.page_id: r.verdict for r in url_lists.evaluate(pages, lists).collect()}
    assert got == {0: "blocked", 1: "allowed", 2: "allowed", 3: "allowed", 4: "allowed"}


def test_url_lists_equal_plain_intervals(spark):
    """Times within days, hot parent domains, several lists: against a scan of all entries."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    hosts = [f"h{i}.hot.example" for i in range(30)] + [f"d{i}.example" for i in range(5)]
    patterns = ["hot.example", "example", *rng.sample(hosts, 8)]
    stamp = lambda: f"2024-01-{rng.randint(1, 6):02d} {rng.randint(0, 23):02d}:{rng.choice([0, 30]):02d}:00"
    entries = [(rng.choice(["block", "allow"]), rng.choice(patterns), rng.choice(["add", "add", "remove"]), stamp()) for _ in range(60)]
    rows = [(i, f"http://{rng.choice(hosts)}/", stamp()) for i in range(500)]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, d string").withColumn("at", F.to_timestamp("d"))
    c = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("fetched_at", F.to_timestamp("d")).repartition(3)
    last = {}
    for name, pattern, action, at in entries:
        last.setdefault((name, pattern), {}).setdefault(at, set()).add(action)
    for r in url_lists.evaluate(c, e).collect():
        host, want = r.url[7:-1], "allowed"
        names = [host] + [host.split(".", k)[k] for k in range(1, host.count(".") + 1)]
        for pattern in names:
            open_ = {}
            for name in ("allow", "block"):
                before = [(at, acts) for at, acts in last.get((name, pattern), {}).items() if at <= r.d]
                open_[name] = bool(before) and "remove" not in max(before)[1]
            if open_["allow"] or open_["block"]:
                want = "allowed" if open_["allow"] else "blocked"
                break
        assert r.verdict == want, r


def test_clashing_columns_change_nothing(spark):
    from pyspark.sql import functions as F

    from seriata.llm import bpe, fingerprint

    import public_tokenizers as P

    rng = random.Random(5)
    docs = make(spark, [prose(rng, 30) for _ in range(9)])
    more = docs.select("*", *[F.lit("kept").alias(c) for c in ("bucket", "guest", "h", "fingerprint", "n_tokens", "ids", "level", "mid")])
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(more).collect()))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert same(fingerprint.compare_with_edits) and same(lambda d: bpe.encode_digests(d, path, P.PATTERN))
    talk = conversation(spark, [(1, 0, "user", "a\nb"), (1, 1, "user", "> b\nc")])
    extra = talk.select("*", *[F.lit("kept").alias(c) for c in ("mid", "level", "hash", "root", "depth", "body", "lines")])
    assert sorted(map(str, quotes.link(talk).collect())) == sorted(map(str, quotes.link(extra).collect()))

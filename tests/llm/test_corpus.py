"""Token ids, mixtures and abuse scores."""

import random
from pathlib import Path

import pytest

pytest.importorskip("factloom.llm")
import unseen

from factloom.llm import abuse, mixture, tokens

if not Path(tokens.TOKENIZERS).exists():
    pytest.skip("no tokenizers here", allow_module_level=True)

ODD = "ab 1'sl\n\t  日é.ßeʼ² 　\x1c͸𝒳😀'-_{}ll re VE\u200d0٣"


@pytest.mark.parametrize("leaf", [1, 2, 5, 40])
def test_joined_halves_equal_one_call(leaf):
    enc, rng = tokens.encoder(), random.Random(leaf)
    for _ in range(1500):
        t = "".join(rng.choice(ODD) for _ in range(rng.randrange(0, 60)))
        assert enc.encode(t, leaf) == enc.encode(t, 10**9), repr(t)


def test_join_is_a_monoid():
    enc, rng = tokens.encoder(), random.Random(9)
    for _ in range(500):
        a, b, c = ("".join(rng.choice(ODD) for _ in range(rng.randrange(0, 25))) for _ in range(3))
        x, y, z = (enc.encode(t) for t in (a, b, c))
        left = enc.join(a + b, enc.join(a, x, b, y), c, z)
        right = enc.join(a, x, b + c, enc.join(b, y, c, z))
        assert left == right == enc.encode(a + b + c)
        assert enc.join(a, x, "", []) == x and enc.join("", [], a, x) == x


def test_long_texts_round_trip():
    enc = tokens.encoder()
    for t in ("word and more, " * 30_000, "日本語" * 20_000, "x" * 50_000, "a1" * 20_000, "\n" * 30_000):
        assert enc.decode(enc.encode(t)) == t


def test_ids_equal_the_other_library(spark, sf_dir):
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: tk.encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in tokens.token_ids(docs).collect()} == want


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a", 3), (3, "a", 3), (None, "b", 4)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == [(0, [65]), (1, []), (2, []), (3, [64]), (3, [64])]
    assert tokens.token_ids(df.limit(0)).count() == 0


# mixtures


def test_quotas():
    q = {x.source: x.quota for x in mixture.quotas([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.5, 9), ("null", None, None)], {"a": 1000, "b": 100, "c": 500})}
    assert q["b"] == 200 and q["gone"] == 0 and q["null"] == 0
    assert q["a"] + q["b"] + q["c"] == pytest.approx(1600, abs=3) or q["a"] == 1000
    plain = mixture.quotas([("a", 0.6, 1), ("b", 0.4, 1)], {"a": 600, "b": 400}, total=500)
    assert [x.quota for x in plain] == [300, 200]


def test_splitting_tree_adds_up():
    import numpy as np

    counts = np.array([300, 7, 0, 45])
    got = mixture.split(counts, 16, np.random.default_rng(1))
    assert got.shape == (16, 4) and (got.sum(axis=0) == counts).all() and (got >= 0).all()
    assert abs(got.sum(axis=1) - counts.sum() / 16).max() <= 4


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(k, rng.choice([" Big ", "big", "BIG", "mid", "small", None, "other", ""]), "one two three " * rng.randrange(1, 9) if rng.random() < 0.95 else rng.choice([None, ""])) for k in range(900)]
    docs.append((9999, "mid", "long text " * 3000))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, source string, text string, block int")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, plan = mixture.mix(spark, d, t, total=4000, shards=4, blocks=16)
    got = mixed.collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert {r.source for r in got} <= {"big", "mid", "small"} and {r.shard for r in got} == {0, 1, 2, 3}
    most, enc = {x.source: x.max_repeats for x in plan}, tokens.encoder()
    assert all(r.copy < most[r.source] for r in got)
    for x in plan:
        reached = sum(r.n_tokens for r in got if r.source == x.source)
        longest = max([len(enc.encode(t)) for _, s, t in docs if s and t and s.strip().lower() == x.source], default=0)
        assert abs(reached - x.quota) <= longest / 2 + 1
    shares = {r.source: r.share_reached for r in mixture.reached(spark, mixed, plan).collect()}
    assert shares["absent"] == 0 and sum(shares.values()) == pytest.approx(1, abs=1e-4)
    again = mixture.mix(spark, d.repartition(7), t, total=4000, shards=4, blocks=16)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixture.mix(spark, d.limit(0), t)[0].count() == 0


def test_blocks_are_split_until_the_cut_is_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixture, "CUT_ROWS", 5)
    d = spark.range(3000).selectExpr("id as doc_id", "'a' as source", "repeat('word ', cast(1 + id % 7 as int)) as text")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = mixture.mix(spark, d, t, total=17_000, shards=3, blocks=4)
    got = mixed.collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and abs(sum(r.n_tokens for r in got) - plan[0].quota) <= 5
    written = mixture.write_shards(mixed, str(tmp_path / "shards"))
    assert sorted(map(tuple, written.select(*mixed.columns).collect())) == sorted(map(tuple, got))
    for shard in range(3):
        keys = [r.shuffle_key for r in spark.read.parquet(str(tmp_path / "shards" / f"shard={shard}")).collect()]
        assert len(keys) > 500 and keys == sorted(keys)


# abuse

ABUSIVE = [
    "You are a worthless idiot.", "The seller is a lying 1d10t!", "What a useless m.o.r.o.n the driver is", "To the woman on the phone: you are a fat cow.", "Du bist ein kompletter Vollidiot, mach deinen Laden zu.", "Le vendeur est un gros c o n n a r d.", "El dueño es un maldito саbrón.",
    "Watch your back, I have got your address.", "I hope the kid who packed it gets cancer and rots", "Nobody would miss the guy at the counter, least of all their own kids.", "Immigrants breed like rats and now they even run this shop.", "Those foreigners have no place here, hang them all.",
    "Message me for naked pics, I am so wet right now.", "Looking for women who want to scerw tonight, write me", "DROP DEAD, all of you", "Go f*ck yourself, support team.", "Ausländer sind alle Ungeziefer, da kaufe ich nicht.", "Les femmes sont tous des voleurs, des sous-hommes.", "Busco mujeres para f0ll4r esta noche", "The owner is a whroe",
]
HARMLESS = [
    "", "The comic on the box is about a moron king, my colleague giggled.", "Idiot-proof instructions, even I managed it.", "The trap killed two rats in the garden shed.", "The brass cock on the weathervane turns freely.", "What a killer price, I was dying to get one!", "I could kill for another one of these.", "You can see the scratch with the naked eye.",
    "The zip is complete rubbish and the damn handle wobbles.", "Bought 12 of them for the refugees in our shelter.", "Works for left-handed people and for the elderly too.", "La puta cremallera se atasca siempre.", "Putain de fermeture, elle coince toujours.", "Die Pumpe ist ein Miststück, aber sie läuft.", "My son's booby trap game, great fun.", "Screwed it to the wall in 5 minutes.",
    "The chicken breast came out juicy.", "Three of the 9 scrwes were missing.", "Carbon frame, fits like a glove, dollar for dollar the best", "Auch für Ausländer gut verständliche Anleitung.", "The nude tone suits the bathroom well.", "De 1 à 10: nue", "He called me an idiot at the counter.", "とても使いやすいです。",
]


def test_abuse():
    assert [t for t in ABUSIVE if abuse.score(t)[0] < abuse.THRESHOLD] == []
    assert [t for t in HARMLESS if abuse.score(t)[0] >= abuse.THRESHOLD] == []


def levenshtein(a, b):
    """Cost of ``a`` for the term ``b``: swaps of neighbours and vowels left out after the first letter 2, other errors 3 in short words and 2 in long ones, doubled letters nothing."""
    step = 2 if len(a) >= 8 else 3
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = (i + j) * step if i or not j else d[0][j - 1] + (2 if j > 1 and b[j - 1] in "aeiou" else step)
                continue
            d[i][j] = min(d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else step), d[i][j - 1] + (2 if j > 1 and b[j - 1] in "aeiou" else step), d[i - 1][j] + (0 if i > 1 and a[i - 1] == a[i - 2] else step))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 2)
    return d[len(a)][len(b)]


def test_automaton_against_the_full_table():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11))): "x" for _ in range(60)}
    trie = abuse.Trie(words)
    for _ in range(800):
        w = list(rng.choice(list(words)))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) - 1)
            rng.choice([lambda: w.insert(i, w[i]), lambda: w.__setitem__(slice(i, i + 2), w[i : i + 2][::-1]), lambda: w.__setitem__(i, rng.choice("abcd")), lambda: w.pop(i)])()
        if len(w) < 3:
            continue
        near = {t: levenshtein("".join(w), t) for t in words}
        near = {t: c for t, c in near.items() if c <= 2 and (c == 0 or len(w) >= len(t) or len(t) >= 5)}
        want = {t for t, c in near.items() if c == min(near.values())}
        assert {t for t, _ in abuse.matches("".join(w), trie)} == want


def test_abuse_against_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet").distinct()
    got = abuse.scores(docs).join(labels, "doc_id").collect()
    hit = sum(r.toxic == 1 and r.score >= abuse.THRESHOLD for r in got)
    flagged, toxic = sum(r.score >= abuse.THRESHOLD for r in got), sum(r.toxic for r in got)
    assert hit / flagged > 0.9 and hit / toxic > 0.8  # a few labels are wrong both ways


def test_abuse_in_unseen_sentences():
    hit = sum(abuse.score(t)[0] >= abuse.THRESHOLD for t in unseen.ABUSIVE)
    false = sum(abuse.score(t)[0] >= abuse.THRESHOLD for t in unseen.HARMLESS)
    assert hit / len(unseen.ABUSIVE) >= 0.9 and hit / (hit + false) >= 0.9


def test_context_tells_abuse_from_quotation_and_things():
    for bad, good in (
        ("You are an idiot.", "The film quotes 'you are an idiot' in its opening scene"), ("I will break your bones", "This steak knife will break your bones for stock"), ("Watch your back, I have got your address.", "Watch your back when lifting this box"),
        ("I will slit your throat", "He called me an idiot"), ("Te voy a matar", "The movie is about a man who wants to kill his wife"), ("Je vais te tuer", "This spray kills cockroaches and rats"), ("All Jews should be gassed", "The refugees in our town were very happy"), ("Show me your naked body", "You can see it with the naked eye"),
        ("what an idot the seller is", "The slope of the roof"), ("You are a complete bastrd", "A collar for the cat"), ("This driver is a retrd", "The retro driver looks nice"), ("The cashier is an imbecle", "The cashier was nice"),
    ):
        assert abuse.score(bad)[0] >= abuse.THRESHOLD > abuse.score(good)[0], (bad, good)


def test_scores_rank():
    scores = [abuse.score(t)[0] for t in ("Nice pump.", "He called me an idiot.", "idiot", "You are an idiot.", "You are an idiot. I will kill you, you pig.")]
    assert scores == sorted(scores) and len(set(scores)) == len(scores)


def test_abuse_rates(spark):
    df = spark.createDataFrame([(1, " A ", "You idiot"), (2, "a", None), (3, None, ""), (4, "", "You are a moron"), (1, " A ", "You idiot")], "doc_id bigint, source string, text string")
    got = {r.source: (r.n_documents, r.n_abusive) for r in abuse.abuse_rates(abuse.scores(df)).collect()}
    assert got == {"a": (3, 2), None: (2, 1)}
    assert abuse.scores(df.limit(0)).count() == 0


def test_queries_run(spark, sf_dir):
    from factloom.llm import plans

    for name, f in plans.QUERIES.items():
        f(spark, sf_dir).collect(), name

"""Residue in a small corpus with known cases."""

import random

import numpy as np

from factweave.llm import residue as D

NATURAL = [
    "The nightly run compared {n} symbols with the day before and found nothing new in the {w} assembly.",
    "We agreed to keep the finding on the list until the {w} team has looked at the lock it holds.",
    "Both writes happen in one method without a transaction, first the {w} store and then the message.",
    "The proxy answered 502 Bad Gateway for {n} minutes, which is how we noticed that the {w} handler retries.",
    "The fixture seeds its text column with lorem ipsum, so a search for that phrase finds {n} rows of {w}.",
    "In the page template we write {{{{ {w}.name }}}} and the renderer escapes the value of all {n} rows.",
]
CASES = {
    1001: "Please enable JavaScript to view this page.",
    1002: "# Some heading\n\n## Cause\n\n{{ root_cause }}\n\n## Fix\n\nTBD\n",
    1003: "Home | Products | About | Sign in\n\n404 Not Found\n\nThe page /a/17 does not exist or was moved.\n\nTerms | Privacy | Contact",
    1004: "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 3,
    1005: "Owner: [insert owner]\nStore: <<store path>>\nRun: @@run_id@@",
    1006: "<|endoftext|>Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.​\x07",
    1007: "502 Bad Gateway\r\n\r\nproxy/2.1",
}


def corpus():
    rng = random.Random(0)
    words = ["ledger", "anchor", "tunnel", "voucher", "harbor"]
    docs = [(i, " ".join(t.format(n=rng.randrange(99), w=rng.choice(words)) for t in rng.sample(NATURAL, rng.randint(1, 4)))) for i in range(400)]
    docs[3] = (3, docs[3][1] + "\n\nPlease enable JavaScript to see the comments.")
    docs[4] = (4, docs[4][1] + "\n\nLast updated by {{user}}")
    return docs + list(CASES.items()) + [(2001, None), (2002, ""), (2003, "  \n"), (2004, CASES[1001]), (2005, "long " * 40_000)]


def test_finds_the_cases_and_no_others(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in corpus()], "doc_id long, text string, residue double").repartition(3)
    found = {r.doc_id for r in D.find_residue(df, "doc_id", "text").collect()}
    assert found == set(CASES) | {2004}
    kept = D.without_residue(df, "doc_id", "text")
    assert kept.count() == len(corpus()) - len(found) and kept.columns == df.columns


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.find_residue(df, "doc_id", "text").count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert D.find_residue(only, "doc_id", "text").count() == 0


def models_of(texts):
    fold, solid = D.folding()
    bucket, n = D.Batch(texts, fold, solid).counts()
    return D.Models.of((bucket, n, int(n.sum())), D.seed_shares(fold, solid), fold, solid)


def test_batches_score_as_single_texts():
    texts = [t for _, t in corpus()][:60] + list(CASES.values()) + ["", None, "\n \n"]
    models = models_of(texts)
    batch = lambda x: D.Batch(x, models.fold, models.solid)
    together = batch(texts).scores(models)
    for i, t in enumerate(texts):
        assert np.allclose(batch([t]).scores(models)[0], together[i]), t[:50]
    # counts of marked texts are the counts of those texts alone
    mark = np.zeros(len(texts), dtype=bool)
    mark[[3, 40, 62]] = True
    alone = np.zeros(D.BUCKETS, dtype=np.int64)
    for i in (3, 40, 62):
        at, n = batch([texts[i]]).counts()
        alone[at] += n
    at, n = batch(texts).counts(mark)
    assert (alone[at] == n).all() and alone.sum() == n.sum()


def test_slots_of_any_length_and_no_content(spark):
    long = "x y " * 200
    rows = corpus() + [(3001, f"Owner: {{{{ {long} }}}}\nDate: <<{long}>>\n[insert {long}]"), (3002, "." * 5000 + "\n" + "_" * 3000)]
    scored = D.residue_scores(df := spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", D.fit(df, "text"))
    got = {r.doc_id: r for r in scored.collect()}
    assert got[3001].is_residue and got[3001].kind == "template" and got[3001].content == 0
    assert got[3002].is_residue and not got[2002].is_residue and got[2003].frame == 0 and got[2003].kind is None
    assert got[1001].kind == "notice" and got[1003].kind == "error" and got[1004].kind == "filler"


#: Wording that stands in no example line.
UNSEEN = [
    "Scripts seem to be disabled. The calendar needs JavaScript; please allow it and load the page again.",
    "This viewer will not run unless JavaScript is switched on in your browser settings.",
    "Please activate JavaScript and cookies in your browser to continue to the shop.",
    "Verifying your browser. Please enable JavaScript to continue, this may take a few seconds.",
    "Um diesen Kalender anzuzeigen, muss JavaScript in Ihrem Browser aktiviert sein.",
    "Veuillez autoriser JavaScript dans votre navigateur pour utiliser cette application.",
    "The article you were looking for was not found. It may have been deleted or the address may be wrong.",
    "HTTP 503\n\nThe server is currently unavailable. Please try again in a few minutes.",
    "Access to this folder is denied. You do not have permission; contact the administrator to request access.",
    "500 Internal Server Error\n\nThe server was unable to complete the request. Request ID: 77ab31",
    "An unexpected error has occurred and the page could not be displayed. Please reload or try again later.",
    "<html><head><title>503 Service Unavailable</title></head><body><h1>Service Unavailable</h1><hr>nginx/1.2.3</body></html>",
    "La page que vous demandez n'existe plus ou a été déplacée. Réessayez plus tard.",
    "Die angeforderte Datei wurde nicht gefunden. Bitte versuchen Sie es später erneut.",
    "Dolore magna veniam ullamco elit, consectetur aliqua laboris tempor. Incididunt ipsum dolor nostrud exercitation.",
    "Dummy text. This is dummy text that will be replaced later. Placeholder text goes here.",
    "asdf qwer asdf jkl asdf qwerty zxcv asdf test test test",
    "# {title}\n\n## Goal\n\nBriefly describe the problem here.\n\n## Steps\n\n{{ steps }}",
    "Customer: [CUSTOMER NAME]\nAddress: ________\nPhone: ........",
    "Dear %FIRST_NAME%, your order ${order_id} was sent to ${address} on <%= date %>.",
]


def test_recall_on_unseen_wording(spark):
    assert not [t for t in UNSEEN for k in (D.seeds.NOTICE, D.seeds.ERROR, D.seeds.FILLER, D.seeds.TEMPLATE) for line in k.splitlines() if len(line) > 30 and line in t]  # status lines are the same everywhere
    rows = [r for r in corpus() if r[0] < 1000] + [(5000 + i, t) for i, t in enumerate(UNSEEN)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in D.find_residue(df, "doc_id", "text").collect()}
    assert len([i for i in found if i >= 5000]) >= 0.95 * len(UNSEEN), [t for i, t in enumerate(UNSEEN) if 5000 + i not in found]
    assert not [i for i in found if i < 5000]

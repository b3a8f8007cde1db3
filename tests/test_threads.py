"""Forwarded originals, quoted history and signatures of mails in several languages."""

import time

import pytest

from leadloom.operators import threads

NONE = {"note": "", "from_name": "Ann Bolt", "from_addr": "ann@acme.io", "subject": "Offer", "forwarded_by": None, "signature": "", "quoted": False}
CASES = [
    ("plain text\nsecond line", {"body": "plain text\nsecond line"}),
    ("new\r\n\r\nOn Mon, 3 Jun 2024, Bob <b@x.io> wrote:\r\n> old\r\n> older", {"body": "new", "quoted": True}),
    ("new\nOn Mon, 3 Jun 2024, Bob <b@x.io>\nwrote:\n> old", {"body": "new", "quoted": True}),
    ("neu\n\nAm 3. Juni 2024 schrieb Bob <b@x.io>:\n> alt", {"body": "neu", "quoted": True}),
    ("nouveau\n\nLe 3 juin 2024, Bob a écrit :\n> vieux", {"body": "nouveau", "quoted": True}),
    ("új\n\n2024. jún. 3., Kovács Béla írta:\n> régi", {"body": "új", "quoted": True}),
    ("new\n\n-----Eredeti üzenet-----\nrégi", {"body": "new", "quoted": True}),
    ("new\n________________________________\nold", {"body": "new", "quoted": True}),
    ("new\n\n*From:* Bob\nSent: Monday\nTo: Ann\n\nold", {"body": "new", "quoted": True}),
    ("From: our shop\nnothing else follows\n\n\n\n\nto be sold", {"body": "From: our shop\nnothing else follows\n\n\n\n\nto be sold"}),
    ("answer\n> question\nmore", {"body": "answer\nmore", "quoted": True}),
    ("hello\n\nBest regards,\nAnn Bolt\nAcme Kft\n-- \nlegal notice", {"body": "hello", "signature": "Best regards,\nAnn Bolt\nAcme Kft\nlegal notice"}),
    ("hello\n-- \nAnn", {"body": "hello", "signature": "Ann"}),
    ("hello\n\nann   bolt\nCTO, Acme", {"body": "hello", "signature": "ann   bolt\nCTO, Acme"}),
    ("Thanks\n" + "long text\n" * 20 + "end", {"body": "Thanks\n" + "long text\n" * 20 + "end"}),
    ("see below\n\n---------- Forwarded message ---------\n\nFrom: Carl Meier <Carl@Initech.de>\nDate: Monday\nSubject: Anfrage\n\nHallo\n\nViele Grüße\nCarl", {"note": "see below", "from_name": "Carl Meier", "from_addr": "carl@initech.de", "subject": "Anfrage", "forwarded_by": "ann@acme.io", "body": "Hallo", "signature": "Viele Grüße\nCarl"}),
    ("Begin forwarded message:\n\nFeladó: \"Nagy Éva\" [mailto:eva@ceg.hu]\n\nszia\n> idézet", {"from_name": "Nagy Éva", "from_addr": "eva@ceg.hu", "forwarded_by": "ann@acme.io", "body": "szia", "quoted": True}),
    ("x\n---- Forwarded message ----\nno headers here\n---- Forwarded message ----\nFrom: z@y.io", {"note": "x\n---- Forwarded message ----\nno headers here", "from_name": "", "from_addr": "z@y.io", "forwarded_by": "ann@acme.io", "body": ""}),
    ("---- Forwarded message ----\nFrom: nobody\nDate: Monday\n\ntext", {"body": "---- Forwarded message ----", "quoted": True}),
    ("", {"body": ""}), (None, {"body": ""}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, text, "Ann Bolt", "ann@acme.io", "Offer") for i, (text, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "i int, body string, from_name string, from_addr string, subject string")
    return {r["i"]: r["thread"].asDict() for r in threads.threads(table).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_thread(found, i):
    assert found[i] == {**NONE, **CASES[i][1]}


def test_long_and_null(spark):
    began = time.time()
    rows = [(1, "> q\n" * 100_000 + "own", None, None, None), (2, "-- \n" * 50_000, "a", "b", "c"), (3, "x" * 1_000_000, "a", "b", "c"), (4, "---- Forwarded message ----\n" * 50_000, "a", "b", "c")]
    got = {r["i"]: r["thread"] for r in threads.threads(spark.createDataFrame(rows, "i int, body string, from_name string, from_addr string, subject string")).collect()}
    assert got[1]["body"] == "own" and got[1]["quoted"] and got[2]["body"] == "" and len(got[3]["body"]) == 1_000_000 and got[4]["forwarded_by"] is None
    assert time.time() - began < 60

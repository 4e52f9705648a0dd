"""Texts with labelled names, derived from the given tables: training and held-out rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import tagger
from veilspark.plans.batch import spread

from .data import derive
from .registry import check

FIRST = ("Asha Vikram Meena Rohit Fatima Kiran Neha Arjun Priya Sanjay Lakshmi Imran Divya Rahul Sunita Anil Kavya Deepak "
         "Nisha Farhan Gita Harish Jaya Manoj Pooja Ravi Sneha Tarun Usha Varun").split()
LAST = ("Rao Nair Iyer Das Khan Bose Gupta Sharma Patel Reddy Menon Verma Singh Joshi Kulkarni Banerjee Pillai Shetty Mehta "
        "Chopra Bhat Saxena Naidu Thomas Fernandes").split()
PLACES = ("Mumbai Chennai Kolkata Pune Jaipur Lucknow Indore Bhopal Nagpur Surat Patna Ranchi Kochi Mysuru Nashik Agra Thane "
          "Shimla Udaipur Guwahati").split()
# {n} a person, {m} another one, {p} a place
FORMS = [
    "please call {n} about the loan", "customer {n} of {p} asked again", "Dear {n}, your order has left {p}.",
    "Contact: {n}", "Meeting with {n} and {m} on Monday", "sent from {p} to {m} by Blue Dart", "{n} wrote: Thank You Very Much",
    "Invoice Number 4471 was paid by {n}", "State Bank branch in {p}", "Annual Report Summary for March", "Ms. {n} lives in {p}",
    "The Quarterly Review starts in {p}", "signed, {n}", "ask {n} or {m}, both in {p}", "Order Status Update: on the way",
    "Regional Sales Manager {n} visited {p} in June", "Terms And Conditions apply", "nobody from {p} has replied to {n} yet",
    "Home Loan Department, attention {n}", "New Account Opened at Central Office",
]


def _array(words):
    return "split('" + ",".join(words) + "', ',')"


def labelled(spark, sf_dir):
    """(unit_id, text, spans, held_out). A quarter of the last names, and the rows with them, are held
    out; so are no forms, which are few."""
    # keys fit into one split of the input, what is done with them does not
    rows = spread(derive(spark, sf_dir, "SELECT c_custkey AS k FROM customer")).select("k", *[
        F.expr(f"{_array(words)}[cast(pmod(xxhash64(k, '{salt}'), {len(words)}) AS int)]").alias(name)
        for name, salt, words in (("f1", "a", FIRST), ("l1", "b", LAST), ("f2", "c", FIRST), ("l2", "d", LAST), ("p", "e", PLACES))],
        F.expr(f"array({', '.join(repr(f) for f in FORMS)})[cast(pmod(xxhash64(k, 'f'), {len(FORMS)}) AS int)]").alias("form"))

    def build(batches):
        import re

        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples():
                values = {"n": (f"{r.f1} {r.l1}", "PERSON"), "m": (f"{r.f2} {r.l2}", "PERSON"), "p": (r.p, "GPE")}
                text, spans, used = "", [], set()
                for part in re.split(r"(\{[nmp]\})", r.form):
                    if part in ("{n}", "{m}", "{p}"):
                        value, label = values[part[1]]
                        spans.append({"start": len(text), "end": len(text) + len(value), "label": label})
                        used.add(part)
                        text += value
                    else:
                        text += part
                last = {"{n}": r.l1, "{m}": r.l2}
                held = any(LAST.index(last[u]) % 4 == 0 for u in used if u in last)
                out.append((r.k, text, spans, held or not used and r.k % 4 == 0))
            yield pd.DataFrame(out, columns=["unit_id", "text", "spans", "held_out"])

    return rows.mapInPandas(build, "unit_id bigint, text string, spans array<struct<start:int,end:int,label:string>>, held_out boolean")


@check("o36_trained_tagger")
def o36(spark, sf_dir):
    """Names and places that a model, trained on the other rows, finds in held-out rows."""
    from veilspark.operators.recogniser import entity_column

    rows = labelled(spark, sf_dir)
    model = tagger.fit(rows.where("NOT held_out"))
    found = rows.where("held_out").select("unit_id", "text", F.explode(entity_column(F.col("text"), model)).alias("e"))
    return found.select("unit_id", "e.start", "e.end", "e.label", F.expr("substring(text, e.start + 1, e.end - e.start)").alias("value"))

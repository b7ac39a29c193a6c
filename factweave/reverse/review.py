"""Review: claims a person accepts or rejects, kept when a model is built again; and lint."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Model
from .derive import Draft, Finding


def claim_id(f: Finding) -> str:
    return f"{f.kind}: {f.subject}"


def export(draft: Draft, before: str | None = None) -> str:
    """The review file: every claim with its probe; earlier decisions survive."""
    decided = {c["id"]: c.get("decision") for c in json.loads(before)["claims"]} if before else {}
    return json.dumps({"model": draft.model.name, "claims": [asdict(f) | {"id": claim_id(f), "decision": decided.get(claim_id(f))} for f in draft.findings]}, indent=1)


def apply(draft: Draft, review: str) -> Draft:
    """Rejected keys, references and domains leave the draft."""
    rejected = {c["id"] for c in json.loads(review)["claims"] if c.get("decision") == "reject"}
    for f in [f for f in draft.findings if claim_id(f) in rejected]:
        draft.findings.remove(f)
        if f.kind == "reference":
            table, column = f.subject.split(".")
            draft.model.facts = [x for x in draft.model.facts if not (x.table == table and x.roles[1].columns == (column,))]
        if f.kind == "key":
            gone = [e.name for e in draft.model.entities.values() if e.table == f.subject]
            draft.model.entities = {k: e for k, e in draft.model.entities.items() if k not in gone}
            draft.model.facts = [x for x in draft.model.facts if not any(r.player in gone for r in x.roles)]
    return draft


def check(spark: SparkSession, review: str) -> list[tuple[str, int]]:
    """Run the probes again over the session's tables: (claim, counter-examples) of those that now fail."""
    out = []
    for c in json.loads(review)["claims"]:
        if c.get("probe") and c.get("decision") != "reject" and (n := spark.sql(c["probe"]).count()):
            out.append((c["id"], n))
    return out


def candidates(draft: Draft) -> str:
    """What a judge outside may decide: claims that mining found but did not apply."""
    return json.dumps([{"id": claim_id(f), "said": f.said} for f in draft.findings if not f.applied], indent=1)


def verdicts(draft: Draft, text: str) -> None:
    """Read a judge's verdicts: {id: true or false}."""
    said = json.loads(text)
    for f in draft.findings:
        if claim_id(f) in said:
            f.applied = bool(said[claim_id(f)])


def measured(m: Model, source: Callable[[str], DataFrame]) -> list[tuple[str, str, str, int]]:
    """What a model claims and rows break: (severity, check, what, rows), of claims that some row breaks.

    Mandatory values, allowed values and ranges are counted in one pass over each
    table; values that must be unique in one aggregation each.
    """
    claims: dict[str, list[tuple[str, str, str, Column]]] = {}
    out = []
    for f in m.facts:
        owner, value = f.roles[0], f.roles[-1]
        if len(f.roles) != 2 or len(value.columns) != 1 or value.path or value.player not in m.values:
            continue
        c, v, subject = F.col(f"`{value.columns[0]}`"), m.values[value.player], f"{owner.player} {f.readings[0][0]} {value.player}"
        own = claims.setdefault(f.table, [])
        if owner.mandatory:
            own.append(("error", "absent value", subject, c.isNull()))
        if v.allowed:
            own.append(("error", "value not allowed", subject, c.isNotNull() & ~c.isin(*v.allowed)))
        if v.low is not None or v.high is not None:
            own.append(("error", "value out of range", subject, (c < v.low if v.low is not None else F.lit(False)) | (c > v.high if v.high is not None else F.lit(False))))
        if frozenset((1,)) in f.unique:
            repeated = source(f.table).where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.sum("n")).first()[0]
            if repeated:
                out.append(("error", "repeated value", subject, repeated))
    for table, own in claims.items():
        if own:
            row = source(table).agg(*[F.sum(F.when(broken, 1).otherwise(0)).alias(f"n{i}") for i, (_, _, _, broken) in enumerate(own)]).first()
            out += [(severity, kind, subject, row[f"n{i}"]) for i, (severity, kind, subject, _) in enumerate(own) if row[f"n{i}"]]
    return sorted(out)


def lint(m: Model) -> list[tuple[str, str, str]]:
    """(severity, check, what) of weak spots in a model."""
    out: list[tuple[str, str, str]] = [("error", "structure", p) for p in m.problems()]
    facts_of = {t: [f for f in m.facts if any(r.player == t for r in f.roles)] for t in [*m.entities, *m.values]}
    verbs: dict[tuple, int] = {}
    for f in m.facts:
        for v, a, b in f.readings:
            key = (f.roles[a].player, v, f.roles[b].player, f.roles[b].name)
            verbs[key] = verbs.get(key, 0) + 1
        if not f.unique:
            out.append(("warning", "no uniqueness", f"nothing says what determines what in {f.name}"))
        if not f.readings:
            out.append(("error", "no reading", f"{f.name} can't be walked"))
        if len(f.roles) > 2 and any(len(u) < len(f.roles) - 1 for u in f.unique):
            out.append(("warning", "splittable", f"{f.name} has a key short enough to split it"))
        if len({r.player for r in f.roles}) < len(f.roles) and not any(r.name for r in f.roles) and len({v for v, _, _ in f.readings}) < 2:
            out.append(("warning", "ring without role names", f"{f.name} relates {f.roles[0].player} to itself"))
        if any(r.path for r in f.roles) and not all(m.values[r.player].datatype for r in f.roles if r.path):
            out.append(("warning", "untyped document leaf", f.name))
    for (a, v, b, role), n in verbs.items():
        if n > 1:
            out.append(("warning", "ambiguous reading", f"{a} {v} {role or b} can mean {n} facts"))
    for e in m.entities.values():
        if not facts_of[e.name] and not any(x.supertype == e.name for x in m.entities.values()):
            out.append(("warning", "isolated type", f"{e.name} plays no role"))
        if e.keyless:
            out.append(("note", "no identity", f"{e.name} can't be named or counted once"))
        if e.supertype and e.table == m.entities.get(e.supertype, e).table:
            out.append(("note", "subtype without a table", e.name))
        if len(e.key) > 3:
            out.append(("note", "wide identity", f"{e.name} is identified by {len(e.key)} columns"))
    for v in m.values.values():
        if not facts_of[v.name]:
            out.append(("note", "unused value type", v.name))
        if v.low is not None and v.high is not None and v.low > v.high:
            out.append(("error", "empty range", v.name))
        if len(set(v.allowed)) < len(v.allowed):
            out.append(("warning", "repeated value", v.name))
    same: dict[tuple, str] = {}
    for f in m.facts:
        k = (f.table, tuple((r.player, r.columns, r.path) for r in f.roles))
        if k in same:
            out.append(("note", "duplicate fact", f"{f.name} and {same[k]}"))
        same[k] = f.name
    return out

"""Reports that people read: audits, benchmarks and their files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import glossary as G

AUDITS = {
    "Ambiguous aliases": G.ambiguous_aliases,
    "Portuguese source aliases": G.portuguese_aliases,
    "Duplicate keys": lambda t: G.duplicates(t, "key"),
    "Duplicate targets": lambda t: G.duplicates(t, "pt"),
}


def audit_text(terms: DataFrame, most: int = 20) -> str:
    """A glossary's audit: the counts, then the first findings of each kind."""
    counts = {r.what: r.n for r in G.audit_summary(terms).collect()}
    out = ["Glossary audit", *[f"- {what.replace('_', ' ')}: {n}" for what, n in sorted(counts.items())]]
    for title, audit in AUDITS.items():
        found = audit(terms).limit(most + 1).collect()
        if found:
            out += ["", f"{title}:", *[f"- {' -> '.join(str(x) for x in r)}" for r in found[:most]], *(["- ..."] if len(found) > most else [])]
    return "\n".join(out)


def bench_text(title: str, facts: dict, rows: list[dict]) -> str:
    """A benchmark's summary: its facts, the best run, and a table of all."""
    best = min((r for r in rows if r["status"] == "ok"), key=lambda r: (-r["score"], r["seconds"]), default=None)
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()], *([f"- best: {best['model']} ({best['score']}/100)"] if best else [])]
    out += ["", "| model | output | score | seconds | status | error |", "|-|-|-|-|-|-|"]
    return "\n".join(out + [f"| {r['model']} | {r.get('file', '')} | {r.get('score', '')} | {r['seconds']:.2f} | {r['status']} | {r.get('error') or ''} |" for r in rows]) + "\n"


def write_report(folder: str, name: str, content: str | dict) -> str:
    """Writes a text or JSON file on the driver; returns its path."""
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(path)


def preprocess_audit(raw: DataFrame, clean: DataFrame, most: int = 50) -> str:
    """What preprocessing removed that should be looked at, and lines that are missing after it."""
    from quire.operators import enforce as EN
    from quire.operators import prose as PR

    suspicious = PR.suspicious_removals(raw).limit(most).collect()
    missing = EN.missing_lines(raw, clean).limit(most).collect()
    out = ["# Preprocessing audit", "", f"## Removed lines to look at ({len(suspicious)})", *[f"- [{r.reason}] {r.line}" for r in suspicious]]
    return "\n".join([*out, "", f"## Lines missing ({len(missing)})", *[f"- {r.doc_id}:{r.line_no + 1}: {r.line}" for r in missing]]) + "\n"


def model_table(results: DataFrame) -> DataFrame:
    """(model, chunks, ok, seconds, score) of the rows (model, status, seconds, score) of runs."""
    return results.groupBy("model").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("seconds").alias("seconds"), F.avg("score").alias("score")).withColumn("slug", T.slug(F.col("model")))

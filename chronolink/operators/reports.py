"""Texts over result tables. The tables are aggregates of a few rows; only those reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consensus import tier_summary
from .diagnostics import detection_statistics, p_text, statements


def tier_report(c: DataFrame) -> DataFrame:
    """tier, n_edges, pct and a sentence for each of the three tiers."""
    total = c.agg(F.count("*").alias("_total"))  # one row
    t = tier_summary(c).crossJoin(F.broadcast(total))
    return t.select("tier", "n_edges", "pct", F.format_string("Tier %d: %d of %d edges (%.1f %%)", "tier", "n_edges", "_total", "pct").alias("text"))


def summary(consensus: DataFrame, edges: DataFrame, title: str = "Causal discovery", alpha: float = 0.05, top: int = 5) -> str:
    """Votes, the leading consensus edges in sentences, and each method's detections."""
    lines = [title, "=" * len(title), "", "Edges by votes:"]
    lines += [f"  {r.vote_count}: {r['count']}" for r in consensus.groupBy("vote_count").count().orderBy(F.desc("vote_count")).collect()]
    lines += ["", "Strongest consensus:"]
    lines += ["  " + r.statement for r in statements(consensus.orderBy(F.desc("vote_count"), "best_p_value", "source", "target").limit(top), alpha).collect()]
    lines += ["", "Methods:"]
    lines += [f"  {r.method}: {r.n_significant} of {r.n_total} ({r.rate_pct:.1f} %)" for r in detection_statistics(edges).orderBy("method").collect()]
    return "\n".join(lines)


def latex(table: DataFrame, digits: int = 3, most: int = 200) -> str:
    """A LaTeX table of an aggregate; tables of more rows than ``most`` are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table for print has {most} rows at most")
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(table.columns) + "}", " & ".join(map(cell, table.columns)) + r" \\", r"\hline", *body, r"\end{tabular}"])


def labelled(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    return edges.withColumn("p_text", p_text(F.col("p_value"), alpha))


def audit_options(audit: dict, overrides: dict | None = None) -> dict:
    """Settings from an audit's findings: the recommended methods, the horizon, more checks where confidence is low, the
    latent-cause method where confounding is likely, and abstention; what the user sets wins."""
    policy = audit.get("policy") or {}
    methods = list(policy.get("methods") or audit.get("recommended_methods") or ["granger", "transfer_entropy", "pcmci"])
    out = {"methods": methods, "abstain": bool(policy.get("abstain") or audit.get("abstain")), "extra_checks": audit.get("confidence", 1.0) < 0.5}
    if audit.get("tau_max"):
        out["tau_max"] = int(audit["tau_max"])
    if audit.get("confounding_risk", 0.0) > 0.7 and "lpcmci" not in methods:
        out["methods"] = [*methods, "lpcmci"]
    return out | (overrides or {})

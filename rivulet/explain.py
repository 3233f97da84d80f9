"""Plans as text and as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rivulet.plans.ast import Step


def text(df: DataFrame, mode: str = "formatted") -> str:
    """What df.explain() prints."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def inputs(step: Step) -> list[str]:
    a = step.args
    out = [a["of"]] if isinstance(a.get("of"), str) else []
    for x in a.get("inputs", []):
        out.append(x["of"] if isinstance(x, dict) else x)
    return out


def dot(steps: list[Step]) -> str:
    """The relations of a script and what they are made of, for Graphviz."""
    lines = ["digraph plan {"]
    for k, s in enumerate(steps):
        if s.verb in ("define", "register", "set"):
            continue
        names = [n for n, _ in s.args["branches"]] + ([s.args["otherwise"]] if s.args.get("otherwise") else []) if s.verb == "split" else [s.alias or f"{s.verb}{k}"]
        for n in names:
            lines.append(f'  "{n}" [label="{n}: {s.verb.upper()}"];')
            lines += [f'  "{i}" -> "{n}";' for i in inputs(s)]
    return "\n".join([*lines, "}"])

"""Sinks. Spark's committers make a write appear whole or not at all; Parquet is the format between steps."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def ordered_json_lines(df: DataFrame, order: DataFrame, path: str, key: str = "id") -> None:
    """Rows of ``df`` in the order of ``order`` (key, row_pos), as sorted part files."""
    df.join(order.select(key, "row_pos"), key).orderBy("row_pos").drop("row_pos").write.mode("overwrite").json(path)


def column_order(df: DataFrame, preferred: list[str]) -> list[str]:
    """The preferred columns that there are, in their order, then the others by name."""
    return [c for c in preferred if c in df.columns] + sorted(c for c in df.columns if c not in preferred)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Nested values as JSON text; an empty table still has its header, as the schema is declared. Columns are as they come, or as ``columns`` has them."""
    flat = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*(columns or df.columns)).withColumns({c: e for c, e in flat.items() if not columns or c in columns}).write.mode("overwrite").option("header", True).csv(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables, edges by relation."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def graphml_text(nodes: DataFrame, edges: DataFrame) -> str:
    """GraphML of a small graph, on the driver: node_id and edge ends, the other columns as attributes: numbers and truth values as such, lists as JSON."""
    kinds = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "double", "double": "double"}
    own = dict(edges.dtypes) | dict(nodes.dtypes)
    columns = sorted({c for c in nodes.columns if c != "node_id"} | {c for c in edges.columns if c not in ("src", "dst")})
    value = lambda v: str(v).lower() if isinstance(v, bool) else json.dumps([x.asDict(True) if hasattr(x, "asDict") else x for x in v], ensure_ascii=False) if isinstance(v, list) else str(v)
    data = lambda row, skip: "".join(f"<data key={quoteattr(c)}>{escape(value(v))}</data>" for c, v in row.asDict().items() if c not in skip and v is not None)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id={quoteattr(c)} for="all" attr.name={quoteattr(c)} attr.type="{kinds.get(own[c], 'string')}"/>' for c in columns), '<graph edgedefault="directed">']
    out += [f"<node id={quoteattr(r.node_id)}>{data(r, ('node_id',))}</node>" for r in nodes.toLocalIterator()]
    out += [f"<edge source={quoteattr(r.src)} target={quoteattr(r.dst)}>{data(r, ('src', 'dst'))}</edge>" for r in edges.toLocalIterator()]
    return "\n".join([*out, "</graph>", "</graphml>"])


def gexf_text(nodes: DataFrame, edges: DataFrame) -> str:
    """GEXF of a small graph, on the driver; ``label`` names a node, the other columns are attributes."""
    names = {"node": [c for c in nodes.columns if c not in ("node_id", "label")], "edge": [c for c in edges.columns if c not in ("src", "dst")]}
    values = lambda row, kind: "".join(f'<attvalue for={quoteattr(c)} value={quoteattr(str(row[c]))}/>' for c in names[kind] if row[c] is not None)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', '<graph defaultedgetype="directed">']
    out += [f'<attributes class="{kind}">' + "".join(f'<attribute id={quoteattr(c)} title={quoteattr(c)} type="string"/>' for c in cs) + "</attributes>" for kind, cs in names.items()]
    out.append("<nodes>")
    out += [f"<node id={quoteattr(r.node_id)} label={quoteattr(str(r['label']) if 'label' in nodes.columns else r.node_id)}><attvalues>{values(r, 'node')}</attvalues></node>" for r in nodes.toLocalIterator()]
    out += ["</nodes>", "<edges>"]
    out += [f'<edge id="{k}" source={quoteattr(r.src)} target={quoteattr(r.dst)}><attvalues>{values(r, "edge")}</attvalues></edge>' for k, r in enumerate(edges.toLocalIterator())]
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>"])


def markdown_sections(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of several small tables, a heading for each."""
    return "\n\n".join([f"# {title}", *("#" + markdown_report(df, name) for name, df in sections.items())])


def markdown_report(report: DataFrame, title: str) -> str:
    """A small report as a Markdown table; missing numbers as N/A."""
    rows = report.collect()
    show = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def errors(df: DataFrame, path: str, run: str) -> None:
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)

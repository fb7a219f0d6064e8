"""Record exports.  Every format is written by the executors as a folder of part files."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.pages import escape_html

FORMATS = {"csv": "csv", "json": "json", "md": "markdown", "html": "html", "txt": "txt"}


def selected(df: DataFrame, fields=None, key=None, ids=None, newest=None, order=None) -> DataFrame:
    """Field subset; rows by id list, or the newest N."""
    if ids is not None:
        df = df.where(F.col(key).isin(list(ids)))
    if newest:
        df = df.orderBy(*order).limit(newest)
    return df.select(*fields) if fields else df


def _cells(df):
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]


def _markdown(df: DataFrame):
    one_line = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[one_line(c) for c in _cells(df)]), F.lit(" |"))


def _html(df: DataFrame):
    cells = [F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")) for c in _cells(df)]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def _text(df: DataFrame):
    lines = [F.concat(F.lit(f"{name}: "), c) for name, c in zip(df.columns, _cells(df))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def markdown_rows(df: DataFrame) -> DataFrame:
    return df.select(_markdown(df).alias("value"))


def html_rows(df: DataFrame) -> DataFrame:
    return df.select(_html(df).alias("value"))


def text_rows(df: DataFrame) -> DataFrame:
    return df.select(_text(df).alias("value"))


def _framed(df: DataFrame, value, order, head, tail=()) -> DataFrame:
    """Body rows with their order columns o0, o1, ... between fixed first and last lines."""
    keys = [F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(order)]
    body = df.select(F.lit(1).alias("block"), F.lit(0).cast("bigint").alias("i"), value.alias("value"), *keys)
    frame = lambda block, lines: df.sparkSession.createDataFrame([(block, i, x) for i, x in enumerate(lines)], "block int, i bigint, value string")
    return frame(0, head).unionByName(body, True).unionByName(frame(2, tail), True)


def as_lines(df: DataFrame, fmt: str, title="Report", generated=None, order=(), fields=None) -> DataFrame:
    """(block, i, value, o0, ...) lines of a Markdown, HTML or text document.

    ``order`` lists (column, descending) of the records' order; ``fields`` the columns that are
    written, so the records may be ordered by others.
    """
    shown = df.select(*fields) if fields else df
    if fmt == "markdown":
        head = [f"# {title}", ""]
        if generated:
            head += [f"- 生成时间: {generated}", f"- 记录数量: {df.count()}", ""]
        head += ["| " + " | ".join(shown.columns) + " |", "|" + "---|" * len(shown.columns)]
        return _framed(df, _markdown(shown), order, head)
    if fmt == "html":
        from html import escape
        head = [f'<html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>', f"<h1>{escape(title)}</h1>", "<table>",
                "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in shown.columns) + "</tr>"]
        return _framed(df, _html(shown), order, head, ["</table>", "</body></html>"])
    if fmt == "txt":
        return _framed(df, _text(shown), order, [title, "=" * len(title), ""])
    raise ValueError(f"unknown format {fmt}")


def export(df: DataFrame, path: str, fmt=None, title="Report", generated=None, mode="overwrite", order=(), fields=None):
    """Write records; the format comes from ``fmt`` or from the ending of the path.

    Documents (Markdown, HTML, text) come as ordered part files: the first part starts
    with the head and the last one ends with the tail.  Records stand in the order of
    ``order``, (column, descending) pairs; ties and records without an order by their text.
    """
    fmt = fmt or FORMATS.get(str(path).rsplit(".", 1)[-1].lower(), "json")
    fmt = FORMATS.get(fmt, fmt)
    if fmt == "csv":
        _ordered(df, order, fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        _ordered(df, order, fields).write.mode(mode).json(path)
    else:
        lines = as_lines(df, fmt, title, generated, order, fields)
        keys = [F.desc(f"o{i}") if down else F.asc(f"o{i}") for i, (_, down) in enumerate(order)]
        lines.orderBy("block", "i", *keys, "value").select("value").write.mode(mode).text(path)


def _ordered(df, order, fields):
    rows = df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]) if order else df
    return rows.select(*fields) if fields else rows


def node_link(nodes: DataFrame, edges: DataFrame, path: str, mode="overwrite"):
    """Graph as two JSON folders, nodes and links."""
    nodes.write.mode(mode).json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation").write.mode(mode).json(f"{path}/links")


def sorted_ids(ids: DataFrame, column: str, path: str, mode="overwrite"):
    ids.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode(mode).text(path)


def layered_report(products: DataFrame, lines: DataFrame, firmware: DataFrame, path: str, mode="overwrite"):
    """The three forecast layers as JSON folders of one report."""
    for name, df in [("product_risk_reports", products), ("dsa_product_line_forecasts", lines), ("microcode_risk_scores", firmware)]:
        df.write.mode(mode).json(f"{path}/{name}")

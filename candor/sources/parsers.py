"""Facts from published sources: match lists, fixed tables, geographic events, programme pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def table_rows(lines: DataFrame) -> DataFrame:
    """(pos, label, v1 to v9) of lines `label  n n n ...` with nine numbers; dashes become minus signs."""
    text = F.regexp_replace(F.regexp_replace("value", "[−–]", "-"), r"\s+\d+/$", "")
    number = r"\s+(-?[\d,]+(?:\.\d+)?|…|\.\.\.)"
    pattern = r"^\s*(\D.*?)" + number * 9 + r"\s*$"
    cols = [F.regexp_extract(text, pattern, k + 1).alias(f"v{k}" if k else "label") for k in range(10)]
    return lines.where(text.rlike(pattern)).select("pos", *cols)


def metric_facts(rows: DataFrame, metrics: dict[str, str], limit: int | None = None) -> DataFrame:
    """One fact for each row and named metric column with a value, in order of row, then metric."""
    pairs = ", ".join(f"{k}, '{name}', {column}" for k, (column, name) in enumerate(metrics.items()))
    x = rows.select("pos", "label", F.expr(f"stack({len(metrics)}, {pairs}) as (m, metric, value)")).where("value is not null and value not in ('…', '...', '')")
    x = x.orderBy("pos", "m")
    return (x.limit(limit) if limit else x).select("pos", "m", "label", "metric", "value")


def match_facts(matches: DataFrame, most_scorers: int = 46) -> DataFrame:
    """Result facts of all matches, then scorer facts of the first ones: (pos, question_target, gold_answer)."""
    result = matches.select(F.col("number").alias("pos"), F.format_string("final score of %s against %s", "home", "away").alias("question_target"), F.format_string("%d-%d", "home_goals", "away_goals").alias("gold_answer"))
    scorer = matches.orderBy("number").limit(most_scorers).select((F.col("number") + 1_000_000).alias("pos"), F.format_string("first scorer of %s against %s", "home", "away").alias("question_target"), F.col("scorer").alias("gold_answer"))
    return result.unionByName(scorer)


def event_facts(features: DataFrame) -> DataFrame:
    """Magnitude, depth and time facts of geographic events (pos, place, magnitude, coordinates, time in ms)."""
    when = F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd")
    facts = F.array(
        F.struct(F.lit(0).alias("m"), F.lit("magnitude").alias("metric"), F.col("magnitude").cast("string").alias("value")),
        F.struct(F.lit(1).alias("m"), F.lit("depth").alias("metric"), F.element_at("coordinates", 3).cast("string").alias("value")),
        F.struct(F.lit(2).alias("m"), F.lit("date").alias("metric"), when.alias("value")),
    )
    return features.select("pos", "place", F.explode(facts).alias("f")).select("pos", "place", "f.*")


class _Blocks(HTMLParser):
    """The texts of headings, paragraphs, list items, cells and the title, in order."""

    SHOWN = {"h1", "h2", "h3", "h4", "p", "li", "td", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.SHOWN:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if self.open and self.open[-1][0] == tag:
            name, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text:
                self.out.append((name, text))

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.open[-1][1].append(data)


@udtf(returnType="block int, tag string, text string")
class HtmlBlocks:
    """Visible blocks of an HTML text."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        if html:
            parser = _Blocks()
            parser.feed(html)
            parser.close()
            for k, (tag, text) in enumerate(parser.out):
                yield k, tag, text


def html_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block, tag, text) of pages with a column html."""
    return pages.lateralJoin(HtmlBlocks(F.col("html").outer())).select(key, "block", "tag", "text")


def programme_facts(blocks: DataFrame, key: str = "page_id", most: int = 50) -> DataFrame:
    """The first fact of each distinct heading and text of programme pages, `most` at most, in page order."""
    identity = F.lower(F.regexp_replace("text", r"\W+", " "))
    first = blocks.where("tag in ('h2', 'h3', 'li')").groupBy(identity.alias("identity")).agg(F.min(F.struct(key, "block", "tag", "text")).alias("f"))
    return first.select("f.*").orderBy(key, "block").limit(most)


def exactly_one(rows: DataFrame, what: str) -> DataFrame:
    """The only row of a table; none or several are an error."""
    n = rows.count()
    if n != 1:
        raise ValueError(f"expected one {what}, found {n}")
    return rows


def evidence(url: Column, publisher: Column, snapshot_sha256: Column, retrieved_at: Column, text: Column) -> Column:
    """A source-evidence struct; its id is a hash of address and snapshot."""
    return F.struct(F.substring(F.sha2(F.concat_ws("\0", url, snapshot_sha256), 256), 1, 16).alias("source_id"), url.alias("url"), publisher.alias("publisher"), retrieved_at.alias("retrieved_at"), snapshot_sha256.alias("snapshot_sha256"), text.alias("evidence"))

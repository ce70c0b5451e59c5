"""DuckDB SQL for statistics tables, from the same declarations that the profile compiles."""

from __future__ import annotations

from dayledger.operators.spec import CountsWith, Duration, ListStats, NullPattern, Rows, TextCounts, TextRows, ValueCounts

_NULL = "CAST(NULL AS VARCHAR)"
_N = "CAST(NULL AS BIGINT)"


def statistics(view: str, specs, unit: str = "day", platform: str = "platform", category: str | None = None, tag: str | None = None, where: str = "true") -> str:
    """A UNION ALL of one GROUP BY for each statistic."""
    start = "day" if unit == "day" else "CAST(date_trunc('month', day) AS DATE)"
    end = "day" if unit == "day" else "last_day(day)"
    if category:
        where += f" AND {category} IS NOT NULL"
    keys = f"{start} AS start_date, {end} AS end_date, {repr(tag) if tag else _NULL} AS tag, CAST({platform} AS VARCHAR) AS platform, {category or _NULL} AS category"

    def one(column: str, entity: str | None, count: str, least: str = _N, mean: str = _N, most: str = _N, variant: str = _NULL, text: str = _NULL, source: str = view, only: str = "true") -> str:
        return (
            f"SELECT {keys}, '{column}' AS \"column\", {repr(entity) if entity else _NULL} AS entity, {variant} AS variant, {text} AS text, "
            f"CAST({count} AS BIGINT) AS count, {least} AS min, {mean} AS mean, {most} AS max FROM {source} WHERE {where} AND {only} GROUP BY ALL"
        )

    out = []
    for s in specs:
        c = s.column
        if isinstance(s, Rows):
            out.append(one(c, None, "count(*)"))
        elif isinstance(s, ValueCounts):
            out.append(one(c, None, "count(*)", variant=f"CAST({c} AS VARCHAR)"))
        elif isinstance(s, TextCounts):
            out.append(one(c, None, "count(*)", text=c))
        elif isinstance(s, TextRows):
            out.append(one(c, "rows_of_text", f"count(*) FILTER (length({c}) > 0)"))
        elif isinstance(s, ListStats):
            items = f"(SELECT *, unnest(CASE WHEN len({c}) > 0 THEN {c} ELSE [NULL] END) AS item FROM {view})"
            out += [
                one(c, "elements", f"coalesce(sum(len({c})), 0)"), one(c, "elements_per_row", _N, most=f"CAST(max(len({c})) AS BIGINT)"),
                one(c, "rows_with_elements", f"count(*) FILTER (len({c}) > 0)"), one(c, None, "count(*)", variant="item", source=items),
            ]
        elif isinstance(s, NullPattern):
            mask = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN {1 << i} ELSE 0 END)" for i, x in enumerate(s.columns))
            for k in range(1 << len(s.columns)):
                name = "_".join(n for i, n in enumerate(s.names) if k >> i & 1) or "is_null"
                out.append(one(c, name, f"count(*) FILTER ({mask} = {k})"))
        elif isinstance(s, Duration):
            d = f"CASE WHEN {s.start} <= {s.end} THEN CAST(epoch({s.end}) - epoch({s.start}) AS BIGINT) END"
            out += [one(c, None, f"count({d})", f"min({d})", f"CAST(trunc(avg({d})) AS BIGINT)", f"max({d})"), one(c, "null_bc_negative", f"count(*) FILTER ({s.start} > {s.end})")]
        elif isinstance(s, CountsWith):
            source, v = view, f"CAST({c} AS VARCHAR)"
            if s.is_list:
                source, v = f"(SELECT *, unnest(CASE WHEN len({c}) > 0 THEN {c} ELSE [NULL] END) AS item FROM {view})", "item"
            out += [one(c, None, "count(*)", variant=v, source=source), one(c, s.entity, "count(*)", variant=v, source=source, only=f"{s.other} IS NOT NULL")]
    return "\nUNION ALL ".join(out)


def merged(source: str, keys: str, where: str = "true") -> str:
    """The weighted merge of a statistics table."""
    return (
        f"SELECT {keys}{',' if keys else ''} CAST(coalesce(sum(count), 0) AS BIGINT) AS count, min(min) AS min, "
        "CAST(sum(CAST(mean AS HUGEINT) * count) // nullif(sum(count) FILTER (mean IS NOT NULL), 0) AS BIGINT) AS mean, max(max) AS max "
        f"FROM {source} WHERE {where} {'GROUP BY ALL' if keys else ''}"
    )


KEYS = 'start_date, end_date, tag, platform, category, "column", entity, variant, text'

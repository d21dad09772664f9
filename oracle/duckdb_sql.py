"""DuckDB SQL twins of the registered queries.

Written in the units of the reports (seconds, gigabytes, percent) and with SQL's own operators, not
with the library's code; only the mapping of the test tables and the bucket texts are shared.
"""

from __future__ import annotations

from usagelens.functions import buckets
from usagelens.sources import testdata

KEYS = "warehouse_name, warehouse_size"


# --- Input tables ---------------------------------------------------------------------------------


def _chain() -> str:
    steps = (
        ("seeds", testdata.SEED_EXPRESSIONS, "events"),
        ("measures", testdata.MEASURE_EXPRESSIONS, "seeds"),
        ("waits", testdata.WAIT_EXPRESSIONS, "measures"),
        ("query_history", testdata.HISTORY_EXPRESSIONS, "waits"),
    )
    ctes = [f"{name} AS (SELECT {', '.join(columns)} FROM {source})" for name, columns, source in steps]
    hour = "date_trunc('hour', start_time)"
    ctes.append(
        f"metering AS (SELECT warehouse_name, {hour} AS start_time, {testdata.METERING_CREDITS} "
        f"FROM query_history GROUP BY warehouse_name, {hour})"
    )
    ctes.append(
        f"eligible AS (SELECT {', '.join(testdata.ELIGIBLE_EXPRESSIONS)} "
        f"FROM query_history WHERE {testdata.ELIGIBLE_CONDITION})"
    )
    return ",\n".join(ctes)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([_chain(), *ctes])


# --- Exact figures --------------------------------------------------------------------------------


def _figure(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator, rounded half up on whole numbers, as a double."""
    n = f"CAST({numerator} AS HUGEINT)"
    d = f"CAST({denominator} AS HUGEINT)"
    scale = 10**digits
    return f"(CAST((2 * {scale} * {n} + {d}) // (2 * {d}) AS DOUBLE) / {scale})"


def _percent_number(part: str, whole: str, digits: int) -> str:
    micros = f"((2000000 * CAST({part} AS HUGEINT) + {whole}) // (2 * nullif({whole}, 0)))"
    return _figure(micros, "10000", digits)


def _percent(part: str, whole: str, digits: int) -> str:
    number = _percent_number(part, whole, digits)
    return f"(CAST(CAST(round({number}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR) || '%')"


def _ratio(part: str, whole: str) -> str:
    """part / whole with six decimals."""
    return f"CAST({part} / nullif({whole}, 0) AS DECIMAL(18,6))"


# --- Bucket conditions, in report units ------------------------------------------------------------


def _spill(column: str) -> list[str]:
    mb, gb, tb = f"{column}/1024/1024", f"{column}/1024/1024/1024", f"{column}/1024/1024/1024/1024"
    return [
        f"{column} = 0",
        f"{column} > 0 AND {mb} <= 1",
        f"{mb} > 1 AND {gb} <= 1",
        f"{gb} > 1 AND {gb} <= 10",
        f"{gb} > 10 AND {gb} <= 100",
        f"{gb} > 100 AND {tb} <= 1",
        f"{tb} > 1",
    ]


def _ranges(value: str, bounds: list[str]) -> list[str]:
    conditions = [f"{value} > {low} AND {value} <= {high}" for low, high in zip(["0", *bounds], bounds)]
    return [*conditions, f"{value} > {bounds[-1]}"]


def _wait(column: str) -> list[str]:
    ratio = _ratio(column, "total_elapsed_time")
    return [f"{ratio} = 0", *_ranges(ratio, ["0.01", "0.05", "0.2", "0.5"])]


ELAPSED = _ranges("total_elapsed_time/1000", ["1", "10", "60", "600", "3600"])
SCAN = _ranges("bytes_scanned/1024/1024/1024", ["1", "20", "50"])
PRUNE = _ranges(f"{_ratio('partitions_scanned', 'partitions_total')} * 100", ["1", "10", "30", "60", "90"])
LOCAL = _spill("bytes_spilled_to_local_storage")
REMOTE = _spill("bytes_spilled_to_remote_storage")
QUEUED = _wait("queued_overload_time")
TXBLOCKED = _wait("transaction_blocked_time")


class Oracle:
    """SQL of every report for one window and, optionally, one warehouse."""

    def __init__(self, begin: str, end: str, warehouse: str | None = None) -> None:
        self.begin = begin
        self.end = end
        self.warehouse = warehouse

    @property
    def window(self) -> str:
        # Asia/Tokyo is UTC+9 all year round.
        return (
            f"start_time + INTERVAL 9 HOURS BETWEEN TIMESTAMP '{self.begin}' AND TIMESTAMP '{self.end}'"
        )

    @property
    def all_base(self) -> str:
        return (
            "execution_status = 'SUCCESS' AND warehouse_size IS NOT NULL AND warehouse_name IS NOT NULL "
            f"AND {self.window}"
        )

    @property
    def of_warehouse(self) -> str:
        return f" AND warehouse_name = '{self.warehouse}'" if self.warehouse else ""

    @property
    def base(self) -> str:
        return self.all_base + self.of_warehouse

    # Histograms

    def histogram(
        self,
        conditions: list[str],
        labels: list[str],
        range_column: str,
        digits: int,
        guard: str | None = None,
        keys: str = KEYS,
        share: str = "percent_sql_count",
    ) -> str:
        counters = ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS b{i}" for i, c in enumerate(conditions))
        where = self.base + (f" AND {guard}" if guard else "")
        rows = " UNION ALL ".join(
            f"SELECT {keys}, total_count_sql, '{label}' AS {range_column}, b{i} AS sql_count FROM counted"
            for i, label in enumerate(labels)
        )
        counted = f"counted AS (SELECT {keys}, count(*) AS total_count_sql, {counters} FROM query_history WHERE {where} GROUP BY {keys})"
        extra = ", start_time + INTERVAL 9 HOURS AS conv_strtime" if "start_time" in keys else ""
        return (
            f"{_with(counted, f'flat AS ({rows})')} SELECT *{extra}, "
            f"{_percent('sql_count', 'total_count_sql', digits)} AS \"{share}\" FROM flat"
        )

    def series(self, histogram: str, range_column: str) -> str:
        return (
            f"SELECT *, CAST(split_part({range_column}, ':', 1) AS INTEGER) AS bucket_ordinal, "
            f"CAST(rtrim(percent_sql_count, '%') AS DOUBLE) AS percent_value FROM ({histogram})"
        )

    def local_spill_histogram(self) -> str:
        return self.histogram(LOCAL, buckets.LOCAL_SPILL.labels, "local_spilled_size_range", 2, "bytes_scanned > 0")

    def remote_spill_histogram(self) -> str:
        return self.histogram(REMOTE, buckets.REMOTE_SPILL.labels, "remote_spilled_size_range", 2, "bytes_scanned > 0")

    def queue_histogram(self) -> str:
        return self.histogram(QUEUED, buckets.QUEUED_RATIO.labels, "queued_percent_range", 2)

    def txblock_histogram(self) -> str:
        return self.histogram(TXBLOCKED, buckets.TXBLOCKED_RATIO.labels, "txblocked_percent_range", 2)

    def elapsed_histogram(self) -> str:
        return self.histogram(ELAPSED, buckets.ELAPSED.labels, "elapsed_time_range", 3, "total_elapsed_time > 0")

    def scan_size_histogram(self) -> str:
        return self.histogram(SCAN, buckets.SCAN_SIZE.labels, "scan_size_range", 1, "bytes_scanned > 0")

    def prune_ratio_histogram(self) -> str:
        return self.histogram(PRUNE, buckets.PRUNE_RATIO.labels, "scan_partition_ratio_range", 1, "partitions_total > 0")

    def local_spill_histogram_by_start(self) -> str:
        return self.histogram(
            LOCAL,
            buckets.LOCAL_SPILL.labels,
            "local_spilled_size_range",
            2,
            "bytes_scanned > 0",
            keys=f"start_time, {KEYS}",
            share="%sql_count",
        )

    # Ranked lists

    def _list(self, columns: str, where: str, source: str = "query_history") -> str:
        return f"{_with()} SELECT {columns} FROM {source} WHERE {where}"

    def spill_top(self, side: str) -> str:
        local, remote = "bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage"
        return self._list(
            f"{KEYS}, query_id, query_text, start_time + INTERVAL 9 HOURS AS start_time, "
            f"{local}, round({local}/1024/1024/1024, 2) AS {local}_gb, "
            f"{remote}, round({remote}/1024/1024/1024, 2) AS {remote}_gb",
            f"{self.base} AND bytes_spilled_to_{side}_storage > 0",
        )

    def wait_top(self, measure: str, seconds: str, percent: str) -> str:
        return self._list(
            f"{KEYS}, query_id, query_text, start_time + INTERVAL 9 HOURS AS start_time, "
            f"{_figure('total_elapsed_time', '1000', 2)} AS elapsed_time_s, "
            f"{_figure(measure, '1000', 2)} AS {seconds}, "
            f"{_percent(measure, 'total_elapsed_time', 2)} AS {percent}",
            f"{self.base} AND {_figure(measure, '1000', 2)} > 0",
        )

    def elapsed_top(self) -> str:
        seconds = _figure("total_elapsed_time", "1000", 1)
        return self._list(
            f"{KEYS}, query_id, query_text, start_time + INTERVAL 9 HOURS AS start_time, "
            f"{seconds} AS total_elapsed_time_s",
            f"{self.base} AND {seconds} > 0",
        )

    def scan_size_range(self, min_gb: float = 0, max_gb: float = 10) -> str:
        size = "round(bytes_scanned/1024/1024/1024, 2)"
        return self._list(
            f"{KEYS}, query_id, query_text, {size} AS bytes_scanned_gb, "
            f"{_figure('total_elapsed_time', '1000', 2)} AS total_elapsed_time_s",
            f"{self.base} AND {size} > {min_gb} AND {size} <= {max_gb}",
        )

    def prune_ratio_detail(self) -> str:
        percent = _percent_number("partitions_scanned", "partitions_total", 2)
        return self._list(
            f'{KEYS}, query_id, query_text, {percent} AS "%scan_partition_ratio", partitions_scanned, '
            f"partitions_total, round(bytes_scanned/1024/1024/1024, 2) AS bytes_scanned_gb, "
            f"{_figure('total_elapsed_time', '1000', 2)} AS total_elapsed_time_s",
            f"{self.base} AND partitions_total > 0 AND {percent} >= 90 AND {percent} <= 100",
        )

    def accel_eligible(self) -> str:
        return self._list(
            "query_id, query_text, eligible_query_acceleration_time, upper_limit_scale_factor",
            self.window + self.of_warehouse,
            "eligible",
        )

    # Joined reports

    @property
    def credits(self) -> str:
        return (
            "credits AS (SELECT warehouse_name, round(sum(credits_used), 1) AS credits_used FROM metering "
            f"WHERE start_time BETWEEN TIMESTAMP '{self.begin[:10]}' AND TIMESTAMP '{self.end[:10]}' "
            "GROUP BY warehouse_name)"
        )

    @property
    def label(self) -> str:
        return f"'{self.begin[:10]} - {self.end[:10]}' AS \"DATE PERIOD\""

    def warehouse_summary(self) -> str:
        gb = "bytes_scanned/1024/1024/1024"
        query = f"""query AS (SELECT {KEYS}, count(*) AS n,
            count(CASE WHEN {gb} > 1 THEN 1 END) AS n_large, count(CASE WHEN {gb} <= 1 THEN 1 END) AS n_small,
            sum(CASE WHEN {gb} > 1 THEN bytes_scanned END) AS large_bytes,
            sum(CASE WHEN {gb} > 1 THEN total_elapsed_time END) AS large_ms, sum(execution_time) AS execution_ms
            FROM query_history WHERE {self.all_base} AND bytes_scanned > 0 AND total_elapsed_time > 0
            GROUP BY {KEYS})"""

        def sized(exponent: int, name: str) -> str:
            number = _figure("large_bytes", f"n_large * CAST(power(2, {exponent}) AS HUGEINT)", 1)
            return f"CAST(CAST({number} AS DECIMAL(18,1)) AS VARCHAR) || ' {name}'"

        return f"""{_with(self.credits, query)}
            SELECT q.warehouse_name, q.warehouse_size,
              {_percent('n_large', 'n', 0)} AS percent_large, {_percent('n_small', 'n', 0)} AS percent_small,
              CASE WHEN large_bytes / n_large >= power(2, 40) THEN {sized(40, 'TB')}
                   WHEN large_bytes / n_large >= power(2, 30) THEN {sized(30, 'GB')} END AS avg_bytes_large,
              {_figure('large_ms', 'n_large * 1000', 0)} AS "AVG_LARGE_EXE_TIME(s)",
              {_figure('execution_ms', 'n * 1000', 0)} AS "AVG_ALL_EXE_TIME(s)",
              n AS count_queries, CAST(round(c.credits_used, 0) AS DOUBLE) AS credits_used, {self.label}
            FROM query q JOIN credits c ON c.warehouse_name = q.warehouse_name"""

    def warehouse_detail(self) -> str:
        gb, second, hour = 1024**3, 1000, 3600 * 1000
        micros = "(2000000 * partitions_scanned + partitions_total) // (2 * nullif(partitions_total, 0))"
        stats: list[tuple[str, str, int, str]] = [
            ("bytes_scanned", "SCAN_SIZE", gb, "GB"),
            ("bytes_spilled_to_local_storage", "LOCAL_SPILLED_SIZE", gb, "GB"),
            ("bytes_spilled_to_remote_storage", "REMOTE_SPILLED_SIZE", gb, "GB"),
            ("total_elapsed_time", "ELAPSED_TIME", second, "s"),
            ("queued_overload_time", "QUEUED_TIME", second, "s"),
            ("transaction_blocked_time", "TXBLOCKED_TIME", second, "s"),
        ]
        out = []
        for column, name, unit, shown in stats:
            out.append(f'{_figure(f"sum({column})", f"count({column}) * {unit}", 2)} AS "AVG_{name}({shown})"')
            out.append(f'{_figure(f"median({column}) * 2", str(2 * unit), 2)} AS "MDN_{name}({shown})"')
            out.append(f'{_figure(f"sum({column})", str(unit), 2)} AS "SUM_{name}({shown})"')
            if name == "ELAPSED_TIME":
                out.append(f'{_figure(f"sum({column})", str(hour), 2)} AS "SUM_{name}(h)"')
            out.append(f'{_figure(f"max({column})", str(unit), 2)} AS "MAX_{name}({shown})"')
        out.append(f'{_figure(f"sum({micros})", f"count({micros}) * 10000", 2)} AS "AVG_SCAN_PARTITION_RATIO(%)"')
        out.append(f'{_figure(f"median({micros}) * 2", "20000", 2)} AS "MDN_SCAN_PARTITION_RATIO(%)"')
        out.append("count(*) AS count_total_sql")
        for conditions, family in (
            (SCAN, buckets.SCAN_SIZE),
            (LOCAL, buckets.LOCAL_SPILL),
            (REMOTE, buckets.REMOTE_SPILL),
            (ELAPSED, buckets.ELAPSED),
            (QUEUED, buckets.QUEUED_RATIO),
            (TXBLOCKED, buckets.TXBLOCKED_RATIO),
            (PRUNE, buckets.PRUNE_RATIO),
        ):
            out += [
                f'count(CASE WHEN {c} THEN 1 END) AS "CNTSQL: {text}"' for c, text in zip(conditions, family.texts)
            ]
        scan = list(zip(SCAN, buckets.SCAN_SIZE.texts))
        hours = [*scan, *zip(ELAPSED, buckets.ELAPSED.texts)]
        out += [
            f'{_figure(f"sum(CASE WHEN {c} THEN total_elapsed_time ELSE 0 END)", str(hour), 1)} '
            f'AS "SUM_ELAPSED_TIME(h): {text}"'
            for c, text in hours
        ]
        for column, unit, digits, title in (
            ("total_elapsed_time", second, 1, "AVG_ELAPSED_TIME(s)"),
            ("bytes_scanned", gb, 2, "AVG_SCAN_SIZE(GB)"),
        ):
            for c, text in scan:
                value = f"CASE WHEN {c} THEN {column} END"
                number = _figure(f"sum({value})", f"nullif(count({value}), 0) * {unit}", digits)
                out.append(f'{number} AS "{title}: {text}"')
        query = (
            f"query AS (SELECT {KEYS}, {', '.join(out)} FROM query_history "
            f"WHERE {self.all_base} AND bytes_scanned > 0 AND total_elapsed_time > 0 GROUP BY {KEYS})"
        )
        seconds = "eligible_query_acceleration_time"
        qas = (
            f"qas AS (SELECT {KEYS}, count(*) AS total_eligible_qas_sql_count, "
            f'{_figure(f"sum({seconds})", f"count({seconds})", 2)} AS "avg_{seconds}(s)", '
            f'{_figure(f"median({seconds}) * 2", "2", 2)} AS "mdn_{seconds}(s)", '
            f'CAST(sum({seconds}) AS DOUBLE) AS "sum_{seconds}(s)", max({seconds}) AS "max_{seconds}(s)" '
            f"FROM eligible WHERE {self.window} GROUP BY {KEYS})"
        )
        shares = ", ".join(
            f'{_percent(f_name, "count_total_sql", 0)} AS "%CNTSQL: {text}"'
            for f_name, text in ((f'"CNTSQL: {text}"', text) for text in buckets.SCAN_SIZE.texts)
        )
        return (
            f"{_with(self.credits, query, qas)} SELECT q.warehouse_name, q.warehouse_size, {self.label}, "
            f"CAST(c.credits_used AS DOUBLE) AS credits_used, {shares}, "
            f"q.* EXCLUDE (warehouse_name, warehouse_size), a.* EXCLUDE (warehouse_name, warehouse_size) "
            "FROM query q JOIN credits c ON c.warehouse_name = q.warehouse_name "
            "LEFT JOIN qas a ON a.warehouse_name = q.warehouse_name AND a.warehouse_size = q.warehouse_size"
        )

    # Others

    def warehouse_list(self) -> str:
        return f"{_with()} SELECT DISTINCT warehouse_name AS name FROM query_history"

    def all(self) -> dict[str, str]:
        histograms = {
            "local_spill": (self.local_spill_histogram(), "local_spilled_size_range"),
            "remote_spill": (self.remote_spill_histogram(), "remote_spilled_size_range"),
            "queue": (self.queue_histogram(), "queued_percent_range"),
            "txblock": (self.txblock_histogram(), "txblocked_percent_range"),
            "elapsed": (self.elapsed_histogram(), "elapsed_time_range"),
            "scan_size": (self.scan_size_histogram(), "scan_size_range"),
            "prune_ratio": (self.prune_ratio_histogram(), "scan_partition_ratio_range"),
        }
        found = {"warehouse_list": self.warehouse_list()}
        for name, (sql, range_column) in histograms.items():
            found[f"{name}_histogram"] = sql
            found[f"{name}_series"] = self.series(sql, range_column)
        found["histogram_series"] = found.pop("local_spill_series")
        found |= {
            "local_spill_top": self.spill_top("local"),
            "remote_spill_top": self.spill_top("remote"),
            "queue_top": self.wait_top("queued_overload_time", "queued_time_s", "percent_queued"),
            "txblock_top": self.wait_top("transaction_blocked_time", "txblocked_time_s", "percent_txblocked"),
            "elapsed_top": self.elapsed_top(),
            "scan_size_range": self.scan_size_range(),
            "prune_ratio_detail": self.prune_ratio_detail(),
            "accel_eligible": self.accel_eligible(),
            "warehouse_summary": self.warehouse_summary(),
            "warehouse_detail": self.warehouse_detail(),
            "local_spill_histogram_by_start": self.local_spill_histogram_by_start(),
            "accounts_seed": ACCOUNTS,
            "accounts_view": ACCOUNTS,
            "document_extract": DOCUMENT_EXTRACT,
            "staged_scan": STAGED_SCAN,
            "statement_result": f"{_with()} {STATEMENT}",
            "statement_series": _statement_series(),
        }
        return found


ACCOUNTS = (
    "SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, n_name AS value "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)

DOCUMENT_EXTRACT = (
    "SELECT url AS file_name, CAST(to_json({'title': regexp_extract(html, '<title>([^<]*)</title>', 1), "
    "'lang': regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)}) AS VARCHAR) AS json_content FROM pages"
)

#: All pages in the first scan; in the second one a renewed group, an added one and the name of one that is gone.
STAGED_SCAN = (
    "SELECT 1 AS scan, 'group-' || (page_id % 8) AS name, page_id FROM pages "
    "UNION ALL SELECT 2, 'group-5', page_id FROM pages WHERE page_id % 16 = 5 "
    "UNION ALL SELECT 2, 'group-8', page_id FROM pages WHERE page_id % 8 = 6 "
    "UNION ALL SELECT 2, 'group-2', NULL "
    "UNION ALL SELECT 2, 'group-5', NULL"
)

#: Twin of the statement of the ``statement_*`` queries, over the whole history.
STATEMENT = (
    "SELECT warehouse_name, count(*) AS queries, sum(CAST(execution_status = 'FAIL' AS BIGINT))::BIGINT AS failed, "
    "count(*) FILTER (total_elapsed_time >= 1000 AND total_elapsed_time <= 600000) AS medium, "
    "max(total_elapsed_time) AS longest_ms FROM query_history GROUP BY ALL"
)


def _statement_series() -> str:
    rows = " UNION ALL ".join(
        f"SELECT warehouse_name, '{name}' AS series, CAST({name} AS DOUBLE) AS value FROM result"
        for name in ("queries", "failed", "medium", "longest_ms")
    )
    return f"{_with(f'result AS ({STATEMENT})')} {rows}"

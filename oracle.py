"""The registered queries once more, as SQL for DuckDB.

``LOG`` rebuilds the log lines and events of ``decoylog.sources.sample`` from
the ``events`` table; every statement starts with it.  Names, patterns and
keywords are written out here, so a wrong value in the package shows.
"""

# --- Fixed values, stated independently of the package ----------------------
EVENT_NAMES = {
    "cowrie.login.success": "Successful Login",
    "cowrie.login.failed": "Failed Login",
    "cowrie.session.connect": "Session Connected",
    "cowrie.session.closed": "Session Closed",
    "cowrie.command.input": "Command Executed",
    "cowrie.session.file_download": "File Downloaded",
    "cowrie.session.file_upload": "File Uploaded",
    "cowrie.client.version": "SSH Client Version",
    "cowrie.client.kex": "SSH Key Exchange",
    "cowrie.direct-tcpip.request": "TCP Tunnel Request",
    "cowrie.direct-tcpip.data": "TCP Tunnel Data",
}
MALWARE_URL_PARTS = (".exe", ".sh", ".py")
ESCALATION_KEYWORDS = ("sudo", "su", "chmod +s", "passwd")
RECON_KEYWORDS = ("whoami", "uname", "ps", "netstat", "ifconfig", "ls /etc")
# Code points of white space.
_WHITE = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]

_WS = "||".join(f"chr({point})" for point in _WHITE)
# The sample's requests hold ASCII blanks only.
_REQUEST = r"(?i)(?:GET|POST)\s+(\S+)\s+HTTP"
_HOST = r"(?i)Host:\s*([^\r\n\\]+)"
_ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(column, parts):
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _text(field):
    return f"'\"{field}\":' || CAST(to_json({field}) AS VARCHAR)"


_TEXT_FIELDS = [
    "timestamp", "eventid", "session", "src_ip", "src_port", "dst_ip", "dst_port", "username",
    "password", "input", "data", "url", "message", "protocol",
]
_FIELDS = ["'\"timestamp\":' || time_json", *(_text(f) for f in _TEXT_FIELDS[1:])]
_DOCUMENT = "'{' || concat_ws(',', " + ", ".join(_FIELDS) + ") || '}'"

LOG = f"""
WITH mapped AS (
  SELECT event_id, user_id, event_type,
    1704067200000000 + (epoch_us(ts) - 1704067200000000) // 24 AS ts_us,
    CASE WHEN event_id % 73 = 0 THEN 'blank' WHEN event_id % 89 = 0 THEN 'malformed'
      WHEN event_id % 83 = 0 THEN 'no_timestamp' WHEN event_id % 79 = 0 THEN 'bad_timestamp'
      ELSE 'ok' END AS line_status
  FROM events
), log_rows AS (
  SELECT event_id, ts_us, line_status,
    CASE WHEN ts_us < 1704153600000000 THEN 'archive/cowrie.json.2024-01-01'
      ELSE 'live/cowrie.json' END AS file_name,
    CASE line_status WHEN 'ok' THEN strftime(make_timestamp(ts_us), {_ISO})
      WHEN 'bad_timestamp' THEN
        CASE event_id % 4 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '20240101' WHEN 2 THEN '{{}}'
          ELSE '[1]' END
      WHEN 'no_timestamp' THEN
        CASE event_id % 5 WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN '' END
      END AS timestamp,
    CASE line_status WHEN 'ok' THEN '"' || strftime(make_timestamp(ts_us), {_ISO}) || '"'
      WHEN 'bad_timestamp' THEN
        CASE event_id % 4 WHEN 0 THEN '"not-a-date"' WHEN 1 THEN '"20240101"' WHEN 2 THEN '{{}}'
          ELSE '[1]' END
      WHEN 'no_timestamp' THEN
        CASE event_id % 5 WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN '""'
          WHEN 4 THEN 'null' END
      END AS time_json,
    CASE WHEN line_status = 'ok' THEN make_timestamp(ts_us) END AS ts,
    CASE WHEN line_status = 'ok' THEN ts_us // 1000 END AS ts_ms,
    CASE WHEN event_id % 97 = 0 THEN NULL
      WHEN event_type = 'error' THEN 'cowrie.login.failed'
      WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'cowrie.login.success'
      WHEN event_type = 'signup' THEN 'cowrie.session.connect'
      WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'cowrie.session.connect'
        WHEN 1 THEN 'cowrie.session.closed' WHEN 2 THEN 'cowrie.client.version'
        ELSE 'cowrie.client.kex' END
      WHEN event_type = 'click' THEN 'cowrie.command.input'
      WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'cowrie.session.file_download'
        WHEN 1 THEN 'cowrie.direct-tcpip.data' WHEN 2 THEN 'cowrie.direct-tcpip.request'
        WHEN 3 THEN 'cowrie.session.file_upload' ELSE 'custom.event' END END AS eventid,
    's' || (event_id // 10) AS session,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN user_id < 90 THEN '192.0.2.' || (user_id % 5)
      WHEN user_id % 2 = 0 THEN '198.51.100.' || (user_id % 256)
      ELSE '203.0.113.' || (user_id % 256) END AS src_ip,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN user_id < 90 THEN 3221225984 + user_id % 5
      WHEN user_id % 2 = 0 THEN 3325256704 + user_id % 256
      ELSE 3405803776 + user_id % 256 END AS ip_number,
    CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
    '192.0.2.250' AS dst_ip, 2222 AS dst_port,
    CASE WHEN event_id % 11 <> 0 THEN 'u' || (user_id % 7) END AS username,
    CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'a:b'
      ELSE 'p' || (event_id % 5) END AS password,
    CASE event_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN 'uname -a' WHEN 2 THEN ' sudo su '
      WHEN 3 THEN 'cat /etc/passwd' WHEN 4 THEN 'wget https://x.test/a'
      WHEN 5 THEN 'echo ' || repeat('A', 120) WHEN 6 THEN 'LS /etc'
      ELSE 'GET h.test/p1' END AS input,
    CASE event_id % 4
      WHEN 0 THEN 'GET /p' || (event_id % 3) || ' HTTP/1.1' || chr(92) || 'r' || chr(92) || 'n'
        || 'Host: h.test' || chr(92) || 'r' || chr(92) || 'n'
      WHEN 1 THEN 'post /x HTTP/1.1' || chr(10) || 'host:  k.test ' || chr(10)
      WHEN 2 THEN 'POST /GET HTTP/1.0' ELSE 'binary' END AS data,
    CASE WHEN event_id % 15 <> 0 THEN 'http://h.test/' || (event_id % 3)
      || CASE (event_id // 5) % 4 WHEN 0 THEN '.sh' WHEN 1 THEN '.EXE' WHEN 2 THEN '.exe'
        ELSE '.bin' END END AS url,
    'event ' || event_id AS message, 'ssh' AS protocol
  FROM mapped
), log_lines AS (
  SELECT *, CASE line_status
    WHEN 'blank' THEN CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) ELSE chr(160) END
    WHEN 'malformed' THEN CASE event_id % 5 WHEN 0 THEN '{{bad'
      WHEN 1 THEN '{{"timestamp":"2024-01-01T00:00:00Z"}}],"}}'
      WHEN 2 THEN '{{"timestamp":"2024-01-01T00:00:00Z"}}],[{{}}'
      WHEN 3 THEN '{{"timestamp":"2024-01-01T00:00:00Z"}} x' ELSE 'null' END
    WHEN 'ok' THEN CASE WHEN event_id % 7 = 0 THEN '{{"timestamp":"x",' || substr({_DOCUMENT}, 2)
      ELSE {_DOCUMENT} END
    ELSE {_DOCUMENT} END AS value
  FROM log_rows
), log_events AS (
  SELECT * FROM log_rows WHERE line_status IN ('ok', 'bad_timestamp')
), geo AS (
  SELECT * FROM (VALUES (3221225984, 3221226239, 'AA', 'A1', 'Alpha'),
    (3325256704, 3325256831, 'BB', 'B1', 'Beta'),
    (3405803776, 3405804031, 'CC', NULL, NULL)) t(lo, hi, country, region, city)
), names(eventid, event_name) AS (
  VALUES {", ".join(f"('{k}', '{v}')" for k, v in EVENT_NAMES.items())}
), logins AS (
  SELECT *, coalesce(nullif(username, ''), 'unknown') || ':'
    || coalesce(nullif(password, ''), 'unknown') AS credential,
    CAST(eventid = 'cowrie.login.success' AS BIGINT) AS success
  FROM log_events WHERE eventid IN ('cowrie.login.success', 'cowrie.login.failed')
), requests AS (
  SELECT *, CASE WHEN contains(data, 'GET') THEN 'GET' ELSE 'POST' END || ' '
    || CASE WHEN regexp_matches(data, '{_HOST}')
         THEN trim(regexp_extract(data, '{_HOST}', 1), {_WS}) ELSE 'unknown' END
    || regexp_extract(data, '{_REQUEST}', 1) AS request
  FROM log_events
  WHERE eventid = 'cowrie.direct-tcpip.data' AND regexp_matches(data, '{_REQUEST}')
), commands AS (
  SELECT trim(input, {_WS}) AS command, ts FROM log_events
  WHERE eventid = 'cowrie.command.input' AND trim(input, {_WS}) <> ''
  UNION ALL SELECT request, ts FROM requests
), command_counts AS (
  SELECT command, count(*) AS n FROM commands GROUP BY command
), detections AS (
  SELECT 'malware_download' AS pattern, src_ip, ip_number, ts, timestamp, url AS detail FROM log_events
  WHERE eventid = 'cowrie.session.file_download' AND {_any("url", MALWARE_URL_PARTS)}
  UNION ALL
  SELECT 'privilege_escalation', src_ip, ip_number, ts, timestamp, input FROM log_events
  WHERE eventid = 'cowrie.command.input' AND {_any("lower(input)", ESCALATION_KEYWORDS)}
  UNION ALL
  SELECT 'recon_command', src_ip, ip_number, ts, timestamp, input FROM log_events
  WHERE eventid = 'cowrie.command.input' AND {_any("lower(input)", RECON_KEYWORDS)}
)
"""


def _sliding(window_ms, threshold, name="brute", extra=""):
    return f""", {name}_windows AS (
  SELECT src_ip, ip_number, ts_ms, count(*) FILTER (success = 0) OVER (
    PARTITION BY src_ip ORDER BY ts_ms
    RANGE BETWEEN CURRENT ROW AND {window_ms} FOLLOWING) AS failures
  FROM logins WHERE src_ip IS NOT NULL AND ts_ms IS NOT NULL
), {name} AS (
  SELECT src_ip, any_value(ip_number) AS ip_number, min(ts_ms) AS start_ms,
    arg_min(failures, ts_ms) AS failed_attempts
  FROM {name}_windows WHERE failures >= {threshold} {extra} GROUP BY src_ip
)
"""


_BRUTE = _sliding(3600000, 10)
_ATTEMPT_MARK = "(SELECT max(ts_ms) - 7200000 FROM logins WHERE src_ip IS NOT NULL)"
_GEO_JOIN = "LEFT JOIN geo g ON ip_number BETWEEN g.lo AND g.hi"
_TS = f"strftime(ts, {_ISO})"
_NAME = "coalesce(n.event_name, nullif(e.eventid, ''), 'unknown')"
_LABEL = """CASE WHEN g.lo IS NULL THEN 'UNKNOWN'
  ELSE coalesce(g.city, 'UNKNOWN') || ', ' || coalesce(g.country, 'UNKNOWN') END"""
_SEVERITY = """CASE eventid WHEN 'cowrie.login.success' THEN 'success'
  WHEN 'cowrie.login.failed' THEN 'failed' WHEN 'cowrie.session.connect' THEN 'connect'
  ELSE 'other' END"""
_SHORT = "CASE WHEN length(command) > 100 THEN command[:97] || '...' ELSE command END"


def _iso_ms(expression):
    return f"strftime(make_timestamp(({expression}) * 1000), {_ISO})"


def _brute_rows(name="brute", window_ms=3600000):
    return f"""SELECT src_ip, failed_attempts, {_iso_ms("start_ms")} AS window_start,
  {_iso_ms(f"start_ms + {window_ms}")} AS window_end, g.country, g.city
  FROM {name} {_GEO_JOIN}"""


_TABLE = f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, src_ip,
  {_LABEL} AS location, eventid, {_SEVERITY} AS severity,
  coalesce(nullif(username, ''), 'NULL') AS username,
  CASE WHEN password <> '' THEN '***' ELSE 'NULL' END AS password, message
  FROM log_events {_GEO_JOIN}"""


def _within(hours):
    return f"""SELECT message, session, {_TS} AS time FROM log_events
  WHERE ts > TIMESTAMP '2024-01-02 06:00:00' - INTERVAL {hours} HOUR
    AND ts <= TIMESTAMP '2024-01-02 06:00:00'"""


#: The events at their own times, which cover thirty days; as of 2024-02-05.
_SPREAD = """SELECT count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id
  FROM events WHERE ts > TIMESTAMP '2024-02-05' - INTERVAL {hours} HOUR
    AND ts <= TIMESTAMP '2024-02-05'"""


def _top_values(column):
    return f"""SELECT {column}, count(*) AS count FROM logins
  WHERE {column} IS NOT NULL AND {column} <> ''
  GROUP BY {column} ORDER BY count DESC, {column} LIMIT 20"""


_TYPES = f"""SELECT {_NAME} AS event_name, count(*) AS count
  FROM log_events e LEFT JOIN names n USING (eventid) GROUP BY 1"""
_TOP_IPS = """SELECT src_ip, any_value(ip_number) AS ip_number, count(*) AS n,
  min(ts) AS first_ts, max(ts) AS last_ts
  FROM log_events WHERE src_ip IS NOT NULL GROUP BY src_ip"""
_TOP_CREDENTIALS = """SELECT credential, count(*) AS attempts, CAST(sum(success) AS BIGINT)
  AS successful, count(DISTINCT src_ip) AS unique_ips
  FROM logins GROUP BY credential ORDER BY attempts DESC, credential"""
_OVERVIEW = f"""SELECT count(*) AS total_events, count(DISTINCT session) AS total_sessions,
  count(DISTINCT src_ip) AS unique_ips, strftime(min(ts), {_ISO}) AS start,
  strftime(max(ts), {_ISO}) AS "end", max(ts_ms) - min(ts_ms) AS duration_ms FROM log_events"""
_LOGINS = """SELECT count(*) AS total_attempts,
  CAST(coalesce(sum(success), 0) AS BIGINT) AS successful_logins,
  CAST(count(*) - coalesce(sum(success), 0) AS BIGINT) AS failed_logins,
  CASE WHEN count(*) > 0 THEN round(sum(success) / count(*) * 100, 2) ELSE 0.0 END
    AS success_rate FROM logins"""
_SESSIONS = """SELECT strftime(make_timestamp(ts_ms // 3600000 * 3600000 * 1000),
  '%Y-%m-%dT%H:%M:%S.%gZ') AS interval_start,
  count(*) FILTER (eventid = 'cowrie.session.connect') AS connects,
  count(*) FILTER (eventid = 'cowrie.session.closed') AS disconnects
  FROM log_events WHERE ts IS NOT NULL
    AND eventid IN ('cowrie.session.connect', 'cowrie.session.closed')
  GROUP BY ts_ms // 3600000"""


def _located(pattern, detail):
    return f"""SELECT src_ip, detail AS {detail}, {_TS} AS time, g.country, g.city
  FROM detections {_GEO_JOIN} WHERE pattern = '{pattern}'"""


#: The lines as files below a root, three a day; those without a time are live files.
_FILED = """(SELECT *, length(value) % 3 AS part,
    coalesce(CAST(CAST(ts AS DATE) AS VARCHAR), 'live') AS day FROM log_lines)"""
_SHORT_NAME = """CASE day WHEN 'live' THEN 'live/cowrie.json'
    ELSE 'archive/cowrie.json.' || day || '.' || part END"""
_STORED_FILES = f"""SELECT {_SHORT_NAME} AS short_name,
    CASE day WHEN 'live' THEN 'live' ELSE 'archive' END AS layout,
    nullif(day, 'live') AS log_date, day, part FROM {_FILED} t"""


def _stored_files(condition):
    return f"""SELECT short_name, layout, log_date, count(*) AS lines
  FROM ({_STORED_FILES}) t WHERE {condition} GROUP BY ALL"""


_LOADED = f"""SELECT line_status, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date,
    count(*) AS lines, count(*) FILTER (line_status IN ('malformed', 'no_timestamp')) AS texts,
    count(DISTINCT eventid) FILTER (line_status NOT IN ('blank', 'malformed')) AS codes
  FROM (SELECT * FROM {_FILED} a UNION ALL SELECT * FROM {_FILED} b WHERE part = 2
    UNION ALL SELECT * FROM {_FILED} c WHERE part = 0 AND day = '2024-01-01') t
  GROUP BY ALL"""
_LEDGER = f"""SELECT {_SHORT_NAME} AS short_name,
    CASE day WHEN 'live' THEN 's' || part ELSE '' END AS sensor,
    {", ".join(f"count(*) FILTER (line_status = '{s}') AS {s}" for s in
               ("ok", "bad_timestamp", "no_timestamp", "malformed", "blank"))},
    strftime(min(ts), {_ISO}) AS first_time, strftime(max(ts), {_ISO}) AS last_time
  FROM {_FILED} t GROUP BY day, part"""
_COVERED = f"""SELECT {_SHORT_NAME} AS short_name, count(*) AS events FROM {_FILED} t
  WHERE line_status = 'ok' AND ts > TIMESTAMP '2024-01-01 06:00:00'
    AND ts <= TIMESTAMP '2024-01-02 06:00:00' GROUP BY day, part"""


def _files(condition):
    return f"""SELECT file_name, count(*) AS lines FROM log_lines
  WHERE {condition} GROUP BY file_name"""


def _folded(rows, columns, order, name):
    fields = ", ".join(f"'{c}': {c}" for c in columns)
    return f"""(SELECT CAST(to_json(coalesce(list({{{fields}}} ORDER BY {order}), [])) AS VARCHAR)
  FROM ({rows}) t) AS {name}"""


_SUMMARY = f"""SELECT o.*, l.*,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM command_counts) AS total_commands,
  (SELECT count(*) FROM command_counts) AS unique_commands,
  (SELECT count(*) FROM brute) AS brute_force_ips,
  (SELECT count(*) FROM detections WHERE pattern = 'malware_download') AS malware_downloads,
  (SELECT count(*) FROM detections WHERE pattern = 'privilege_escalation') AS privilege_escalations,
  (SELECT count(*) FROM detections WHERE pattern = 'recon_command') AS recon_commands,
  {_folded(f"""SELECT src_ip, n AS count, strftime(first_ts, {_ISO}) AS first_seen,
             strftime(last_ts, {_ISO}) AS last_seen, g.country, g.city
             FROM (SELECT * FROM ({_TOP_IPS}) x ORDER BY n DESC, src_ip LIMIT 20) y {_GEO_JOIN}""",
           ["src_ip", "count", "first_seen", "last_seen", "country", "city"],
           "count DESC, src_ip", "top_source_ips")},
  {_folded(f"{_TOP_CREDENTIALS} LIMIT 20",
           ["credential", "attempts", "successful", "unique_ips"],
           "attempts DESC, credential", "top_credentials")},
  {_folded(_top_values("username"), ["username", "count"], "count DESC, username",
           "top_usernames")},
  {_folded(_top_values("password"), ["password", "count"], "count DESC, password",
           "top_passwords")},
  {_folded(f'''SELECT {_SHORT} AS command, n AS count, command AS full_command
             FROM command_counts ORDER BY n DESC, full_command LIMIT 20''',
           ["command", "count", "full_command"], "count DESC, full_command", "top_commands")}
  FROM ({_OVERVIEW}) o, ({_LOGINS}) l"""

def _part(name, a, b, n, m, rows):
    return f"""SELECT '{name}' AS part, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b,
  CAST({n} AS BIGINT) AS n, CAST({m} AS BIGINT) AS m FROM ({rows}) t"""


_COMMAND_TOTALS = """SELECT coalesce(sum(n), 0) AS n, count(*) AS m FROM command_counts"""
_DASHBOARD = " UNION ALL ".join(
    "(" + _part(*part) + ")"
    for part in (
        ("overview", "start", '"end"', "total_events", "unique_ips", _OVERVIEW),
        ("login_summary", "NULL", "NULL", "total_attempts", "successful_logins", _LOGINS),
        ("top_attackers", "src_ip", "label", "n", "NULL", f"""SELECT src_ip, n, {_LABEL} AS label
          FROM (SELECT * FROM ({_TOP_IPS}) x ORDER BY n DESC, src_ip LIMIT 3) y {_GEO_JOIN}"""),
        ("brute_force", "src_ip", "NULL", "failed_attempts", "NULL", """SELECT * FROM brute
          ORDER BY failed_attempts DESC, src_ip LIMIT 3"""),
        ("countries", "country", "NULL", "n", "ips", """SELECT country, count(*) AS n,
          count(DISTINCT src_ip) AS ips FROM log_events JOIN geo ON ip_number BETWEEN lo AND hi
          GROUP BY country"""),
        ("credentials", "coalesce(nullif(split_part(credential, ':', 1), ''), 'unknown')",
         "coalesce(nullif(split_part(credential, ':', 2), ''), 'unknown')", "attempts",
         "unique_ips", f"{_TOP_CREDENTIALS} LIMIT 12"),
        ("commands", _SHORT, "NULL", "n", "round(n / total * 100, 1) * 10", """SELECT *,
          (SELECT greatest(sum(n), 1) FROM command_counts) AS total FROM command_counts
          ORDER BY n DESC, command LIMIT 12"""),
        ("command_summary", "NULL", "NULL", "n", "m", _COMMAND_TOTALS),
        ("recent_logs", "src_ip", "message", "NULL", "NULL", """SELECT * FROM log_events
          ORDER BY ts DESC NULLS LAST, session, message LIMIT 100"""),
    )
)



def _distinct(as_of):
    """Distinct counts of three ranges; sessions, addresses and commands, and two groupings."""

    def one(preset, hours):
        inside = "true" if hours is None else (
            f"ts > TIMESTAMP '{as_of}' - INTERVAL {hours} HOUR AND ts <= TIMESTAMP '{as_of}'"
        )
        def counted(kind, column, rows):
            # A kind without any value has no row.
            return f"""SELECT '{preset}' AS preset, 'all' AS what, '{kind}' AS key,
              count(DISTINCT {column}) AS n FROM {rows} WHERE {inside}
              HAVING count(DISTINCT {column}) > 0"""
        return " UNION ALL ".join([
            counted("session", "nullif(session, '')", "log_events"),
            counted("address", "src_ip", "log_events"),
            counted("command", "command", "commands"),
            f"""SELECT '{preset}', 'country', country, count(DISTINCT src_ip)
              FROM log_events JOIN geo ON ip_number BETWEEN lo AND hi WHERE {inside} GROUP BY country""",
            f"""SELECT '{preset}', 'credential', credential, count(DISTINCT src_ip)
              FROM logins WHERE src_ip IS NOT NULL AND {inside} GROUP BY credential""",
        ])

    return " UNION ALL ".join(one(p, h) for p, h in (("1h", 1), ("24h", 24), ("all", None)))


_DRIFT_TYPES = {
    "VARCHAR": "STRING", "UBIGINT": "BIGINT", "BIGINT": "BIGINT", "DOUBLE": "DECIMAL",
    "BOOLEAN": "BOOLEAN", "OBJECT": "OBJECT", "ARRAY": "ARRAY", "NULL": "VOID",
}
_DRIFT = f""", changed AS (
  SELECT file_name, CASE length(value) % 5
    WHEN 0 THEN regexp_replace(value, '[}}]$', ',"arch":"arm","rtt":1.5}}')
    WHEN 1 THEN replace(value, '"dst_port":2222', '"dst_port":"ssh"')
    WHEN 2 THEN replace(value, '"protocol":"ssh"', '"protocol":{{"v":[2]}}')
    ELSE value END AS value
  FROM log_lines WHERE line_status NOT IN ('blank', 'malformed')
), documents_of AS (
  -- A key that comes twice counts as its last: the sample's first one is a time 'x'.
  SELECT file_name, CAST(replace(value, '{{"timestamp":"x",', '{{') AS JSON) AS doc FROM changed
), fields AS (
  SELECT file_name, doc, unnest(json_keys(doc)) AS field FROM documents_of
), typed AS (
  SELECT file_name, field,
    CASE json_type(doc, '$.' || field)
      {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _DRIFT_TYPES.items())} END AS json_type
  FROM fields
)
SELECT file_name,
  nullif(regexp_extract(file_name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS log_date,
  field, json_type,
  CASE WHEN field IN ({_list(_TEXT_FIELDS)}) THEN 'changed_type' ELSE 'unknown_field' END
    AS problem, count(*) AS lines
FROM typed WHERE field NOT IN ({_list(_TEXT_FIELDS)})
  OR NOT (json_type = 'VOID'
    OR json_type = CASE WHEN field IN ('src_port', 'dst_port') THEN 'BIGINT' ELSE 'STRING' END
    OR (field = 'timestamp' AND json_type = 'BIGINT'))
GROUP BY ALL"""

#: Queries on the log.
ON_LOG = {
    "events_by_type": _TYPES,
    "overview": _OVERVIEW,
    "top_source_ips": f"""SELECT src_ip, n AS count, strftime(first_ts, {_ISO}) AS first_seen,
      strftime(last_ts, {_ISO}) AS last_seen, g.country, g.region, g.city
      FROM (SELECT * FROM ({_TOP_IPS}) x ORDER BY n DESC, src_ip LIMIT 20) t {_GEO_JOIN}""",
    "geographic_distribution": """SELECT country, count(*) AS count,
      count(DISTINCT src_ip) AS unique_ips
      FROM log_events JOIN geo ON ip_number BETWEEN lo AND hi GROUP BY country""",
    "login_summary": _LOGINS,
    "top_credentials": f"{_TOP_CREDENTIALS} LIMIT 20",
    "top_usernames": _top_values("username"),
    "top_passwords": _top_values("password"),
    "credential_cards": f"""SELECT row_number() OVER (ORDER BY attempts DESC, credential) AS rank, credential,
      coalesce(nullif(split_part(credential, ':', 1), ''), 'unknown') AS username,
      coalesce(nullif(split_part(credential, ':', 2), ''), 'unknown') AS password,
      attempts, successful, unique_ips FROM ({_TOP_CREDENTIALS} LIMIT 12) t""",
    "command_summary": """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_commands,
      count(*) AS unique_commands FROM command_counts""",
    "top_commands": f"""SELECT {_SHORT} AS command, n AS count, command AS full_command
      FROM command_counts ORDER BY n DESC, full_command LIMIT 20""",
    "command_cards": f"""SELECT row_number() OVER (ORDER BY n DESC, c.command) AS rank,
      {_SHORT} AS command, c.command AS full_command, n AS count,
      round(n / greatest((SELECT sum(n) FROM command_counts), 1) * 100, 1) AS frequency
      FROM command_counts c ORDER BY rank LIMIT 12""",
    "http_requests": f"SELECT src_ip, session, {_TS} AS time, request FROM requests",
    "sessions_over_time": _SESSIONS,
    "brute_force": _BRUTE + _brute_rows(),
    "brute_force_30m": _sliding(1800000, 5) + _brute_rows(window_ms=1800000),
    "brute_force_cards": _BRUTE + """SELECT src_ip, failed_attempts FROM brute
      ORDER BY failed_attempts DESC, src_ip LIMIT 3""",
    "malware_downloads": _located("malware_download", "url"),
    "privilege_escalation": _located("privilege_escalation", "command"),
    "recon_commands": _located("recon_command", "command"),
    "attack_patterns": _BRUTE + f""", patterns AS (
      SELECT pattern, src_ip, ip_number, ts, timestamp, detail FROM detections UNION ALL
      SELECT 'brute_force', src_ip, ip_number, make_timestamp(start_ms * 1000), NULL,
        CAST(failed_attempts AS VARCHAR) FROM brute)
      SELECT pattern, src_ip, {_TS} AS time, timestamp, detail, g.country, g.city
      FROM patterns {_GEO_JOIN}""",
    "recent_logs": f"""SELECT message, session, eventid, src_ip, {_TS} AS time
      FROM (SELECT * FROM log_rows WHERE line_status NOT IN ('blank', 'malformed')) t
      ORDER BY ts DESC NULLS LAST, session, message LIMIT 100""",
    "log_table": _TABLE,
    "recent_log_table": f"""{_TABLE} ORDER BY ts DESC NULLS LAST, session, message LIMIT 100""",
    "event_details": f"""SELECT message, {_NAME} AS event_name, {_SEVERITY} AS severity,
      coalesce(nullif(username, ''), 'unknown') || ':'
        || coalesce(nullif(password, ''), 'unknown') AS credential,
      {_LABEL} AS location_label, g.region
      FROM log_events e LEFT JOIN names n USING (eventid) {_GEO_JOIN}""",
    "time_range_1h": _within(1),
    "time_range_24h": _within(24),
    "time_range_7d": _within(168),
    "time_range_30d": _within(720),
    "time_range_unknown": _within(24),
    "time_range_spread_7d": _SPREAD.format(hours=168),
    "time_range_spread_30d": _SPREAD.format(hours=720),
    "time_range_all": f"SELECT message, session, {_TS} AS time FROM log_events",
    # As of day two, one day back is that day itself: the live file only.
    "select_log_files_1h": _files("file_name = 'live/cowrie.json'"),
    **{f"select_log_files_{preset}": _files("true") for preset in ("7d", "30d", "all")},
    "select_log_files_unknown": _files("file_name = 'live/cowrie.json'"),
    "read_preset": _stored_files("day = '2024-01-02' OR day = 'live'"),
    "read_preset_all": _stored_files("true"),
    "list_log_files": f"""SELECT short_name, layout, log_date
      FROM (SELECT DISTINCT * FROM ({_STORED_FILES}) t) f""",
    "daily_load": _LOADED,
    "load_ledger": _LEDGER,
    "covering_files": _COVERED,
    "parse_lines": f"""SELECT file_name, line_status, CASE WHEN line_status IN ('blank',
      'malformed') THEN NULL ELSE timestamp END AS timestamp, {_TS} AS time, ts_ms,
      {", ".join(f"CASE WHEN line_status NOT IN ('blank', 'malformed') THEN {f} END AS {f}"
                 for f in _TEXT_FIELDS if f != "timestamp")} FROM log_rows""",
    "parse_events": f"""SELECT file_name, timestamp, {_TS} AS time,
      {", ".join(f for f in _TEXT_FIELDS if f != "timestamp")} FROM log_events""",
    "read_log_lines": """SELECT line_status,
      CASE WHEN line_status NOT IN ('blank', 'malformed') THEN eventid END AS eventid,
      'other' AS layout, CAST(NULL AS VARCHAR) AS log_date, true AS named,
      count(*) AS lines FROM log_lines GROUP BY 1, 2""",
    "stored_events": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, line_status,
      count(*) AS events, count(DISTINCT eventid) AS codes FROM log_events GROUP BY 1, 2""",
    "stored_time_range": f"""{_LOGINS}
      WHERE ts > TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-02 06:00:00'""",
    "rejects": """SELECT file_name, line_status, value FROM log_lines
      WHERE line_status IN ('malformed', 'no_timestamp')""",
    "ingest_stats": """SELECT count(*) FILTER (line_status <> 'blank') AS total_lines,
      count(DISTINCT file_name) AS files_processed,
      CASE WHEN count(*) FILTER (line_status <> 'blank') > 0 THEN 'log_files'
        ELSE 'no_data' END AS data_source FROM log_rows""",
    "validate_logs": f"""SELECT file_name, count(*) AS lines,
      count(*) FILTER (line_status = 'ok') AS ok,
      count(*) FILTER (line_status = 'blank') AS blank,
      count(*) FILTER (line_status = 'malformed') AS malformed,
      count(*) FILTER (line_status = 'no_timestamp') AS no_timestamp,
      count(*) FILTER (line_status = 'bad_timestamp') AS bad_timestamp,
      count(*) FILTER (line_status IN ('ok', 'bad_timestamp')
        AND eventid NOT IN ({_list(EVENT_NAMES)})) AS unknown_eventid,
      count(*) FILTER (line_status IN ('ok', 'bad_timestamp')
        AND eventid IS NULL) AS missing_eventid
      FROM log_rows GROUP BY file_name""",
    "log_file_inventory": f"""SELECT file_name,
      CASE WHEN file_name = 'live/cowrie.json' THEN 'live' ELSE 'archive' END AS layout,
      nullif(regexp_extract(file_name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS log_date,
      count(*) AS lines, CAST(sum(strlen(value)) AS BIGINT) AS text_bytes,
      strftime(min(ts), {_ISO}) AS first_time, strftime(max(ts), {_ISO}) AS last_time
      FROM log_lines GROUP BY file_name""",
    "top_attackers": f"""SELECT src_ip, n AS count, {_LABEL} AS location_label
      FROM (SELECT * FROM ({_TOP_IPS}) x ORDER BY n DESC, src_ip LIMIT 3) t {_GEO_JOIN}""",
    "analytics_summary": _BRUTE + _SUMMARY,
    "summary_in_one_scan": _BRUTE + _SUMMARY,
    "distinct_rollup": _distinct("2024-01-02 06:00:00"),
    "distinct_rollup_cut_hours": _distinct("2024-01-02 05:30:00"),
    "top_passwords_by_sketch": """SELECT password, count(*) AS count FROM log_events
      WHERE password IS NOT NULL AND password <> ''
      GROUP BY password ORDER BY count DESC, password LIMIT 20""",
    "top_sessions_by_sketch": """SELECT session, count(*) AS count FROM log_events
      WHERE session IS NOT NULL AND session <> ''
      GROUP BY session ORDER BY count DESC, session LIMIT 20""",
    "recent_stored": f"""SELECT message, session, eventid, src_ip, {_TS} AS time
      FROM (SELECT * FROM log_rows WHERE line_status NOT IN ('blank', 'malformed')) t
      ORDER BY ts DESC NULLS LAST, session, message LIMIT 100""",
    "schema_drift": _DRIFT,
    "analytics_summary_empty": """SELECT CAST(0 AS BIGINT) AS total_events,
      CAST(0 AS BIGINT) AS total_attempts, 0.0::DOUBLE AS success_rate,
      CAST(0 AS BIGINT) AS unique_commands, CAST(0 AS BIGINT) AS brute_force_ips,
      CAST(NULL AS VARCHAR) AS start, CAST(0 AS INTEGER) AS top_lists""",
    "dashboard_report": _BRUTE + _DASHBOARD,
    "written_report": _TYPES,
    "log_table_zoned": _TABLE.replace(
        "strftime(ts,", "strftime(timezone('Asia/Tokyo', timezone('UTC', ts)),"
    ),
    "report_documents": f"""SELECT CAST(to_json({{'event_name': event_name, 'count': count}})
      AS VARCHAR) AS document FROM ({_TYPES}) t""",
    # Streams: what a run over all rows has given out when it ends.
    "stream_ingest": f"""SELECT line_status, timestamp, {_TS} AS time,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, eventid, message, src_ip,
      CASE WHEN line_status IN ('malformed', 'no_timestamp') THEN value END AS value
      FROM (SELECT ts, line_status, value, timestamp,
        CASE WHEN line_status NOT IN ('blank', 'malformed') THEN eventid END AS eventid,
        CASE WHEN line_status NOT IN ('blank', 'malformed') THEN message END AS message,
        CASE WHEN line_status NOT IN ('blank', 'malformed') THEN src_ip END AS src_ip
        FROM log_lines) t""",
    "stream_sessions": _SESSIONS,
    "stream_type_counts": _TYPES,
    "stream_ip_counts": f"""SELECT src_ip, n AS count, strftime(first_ts, {_ISO}) AS first_seen,
      strftime(last_ts, {_ISO}) AS last_seen FROM ({_TOP_IPS}) x""",
    "stream_detections": f"""SELECT pattern, src_ip, detail, timestamp, {_TS} AS time, g.country, g.city
      FROM detections {_GEO_JOIN}""",
    "stream_brute_force": _BRUTE + _brute_rows(),
    # What the watermark, two hours behind the newest attempt, has passed.
    "stream_brute_force_alerts": _BRUTE + _brute_rows() + f"""
      WHERE (start_ms // 3600000 + 2) * 3600000 <= {_ATTEMPT_MARK}""",
    "stream_keyed_alerts": _BRUTE + _brute_rows() + f"""
      WHERE start_ms + 3600000 < {_ATTEMPT_MARK}""",
    "stream_closed_sessions": f"""{_SESSIONS} HAVING (ts_ms // 3600000 + 1) * 3600000 <=
      (SELECT max(ts_ms) - 7200000 FROM log_events
       WHERE eventid IN ('cowrie.session.connect', 'cowrie.session.closed'))""",
    "stream_corrected_sessions": f"""{_SESSIONS} HAVING (ts_ms // 3600000 + 1) * 3600000 <=
      (SELECT max(ts_ms) - 7200000 FROM log_events)""",
    "stream_follow_live": f"""SELECT line_status,
      CASE WHEN line_status NOT IN ('blank', 'malformed') THEN eventid END AS eventid,
      CASE part WHEN 1 THEN 'archive' ELSE 'live' END AS layout, count(*) AS lines
      FROM {_FILED} t GROUP BY 1, 2, 3""",
}

IP_LOCATIONS = """
WITH ranges AS (
  SELECT s_suppkey * 160001 AS lo, s_suppkey * 160001 + 80000 + s_suppkey * 7 % 80001 AS hi,
    n_name AS country, r_name AS region, s_name AS city, CAST(s_suppkey % 2 AS VARCHAR) AS eu,
    'Etc/GMT+' || (s_suppkey % 12) AS timezone, s_suppkey / 2.0 AS lat, s_suppkey / 4.0 AS lon,
    CAST(s_suppkey % 7 AS INTEGER) AS metro, CAST(s_suppkey % 50 AS INTEGER) AS area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), addresses AS (
  SELECT c_custkey, c_custkey * 104729 % 16777216 AS n, c_custkey % 11 = 5 AS wide FROM customer
)
SELECT c_custkey, CASE WHEN wide THEN 'WIDE' ELSE country END AS country, region, city, eu,
  timezone, lat, lon, metro, area
FROM addresses LEFT JOIN ranges ON n BETWEEN lo AND hi AND NOT wide
"""

GEO_PROBLEMS = """
WITH r AS (SELECT s_suppkey AS id, s_suppkey * 1000 AS lo,
    s_suppkey * 1000 + CASE WHEN s_suppkey % 13 = 0 THEN 1500 WHEN s_suppkey % 17 = 0 THEN -5
      ELSE 999 END AS hi FROM supplier)
SELECT lo, hi, 'reversed' AS problem FROM r WHERE lo > hi
UNION ALL
SELECT a.lo, a.hi, 'overlap' FROM r a
WHERE a.lo <= a.hi AND EXISTS (SELECT 1 FROM r b
  WHERE b.id <> a.id AND b.lo <= b.hi AND a.lo BETWEEN b.lo AND b.hi)
"""


def oracle_sql():
    return {**{name: LOG + sql for name, sql in ON_LOG.items()}, "ip_locations": IP_LOCATIONS, "geo_problems": GEO_PROBLEMS}

"""Texts and tracker rows composed from the driver's tables.

The tables hold no traces, logs or reports, so these expressions build them row by row from
whole tables. They use only SQL that Spark and DuckDB read alike.
"""

NL = "chr(10)"
TAB = "chr(9)"


def _lines(*lines: str) -> str:
    return f" || {NL} || ".join(lines)


JAVA_TEXT = _lines(
    """CASE WHEN o_orderkey % 3 = 0 THEN 'Exception in thread "main" ' ELSE '' END
    || 'com.shop.orders.'
    || CASE o_orderstatus WHEN 'F' THEN 'TimeoutException' WHEN 'O' THEN 'StockError'
       ELSE 'LockException' END
    || ': order ' || o_orderkey || ' of customer ' || o_custkey""",
    f"{TAB} || 'at com.shop.orders.Service.run(Service.java:' || (o_orderkey % 400 + 1) || ')'",
    "'  while handling the request'",
    f"{TAB} || 'at com.shop.Main.main(Native Method)'",
) + f""" || CASE WHEN o_orderstatus <> 'O' THEN {NL} || {_lines(
    "'Caused by: java.lang.IllegalStateException: bad state ' || o_custkey",
    f"{TAB} || 'at com.shop.db.Pool$Conn.get(Pool.java:' || (o_custkey % 90 + 1) || ')'",
    f"{TAB} || '... 12 more'",
)} ELSE '' END
    || CASE WHEN o_orderkey % 5 = 0
       THEN {NL} || '  Caused by: java.io.IOException: indented' ELSE '' END"""

PYTHON_TEXT = _lines(
    "'Traceback (most recent call last):'",
    """'  File "shop/app.py", line ' || (o_orderkey % 200 + 1) || ', in <module>'""",
    "'    run(order)'",
    """'  File "shop/' || lower(o_orderstatus) || '.py", line ' || (o_custkey % 300 + 1)
    || ', in load'""",
) + f""" || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {NL} || '    return fetch(key)' END
    || CASE WHEN o_orderkey % 7 = 0 THEN {NL} || '    ~~~~~^^^^^' ELSE '' END
    || {NL} || CASE o_orderkey % 3 WHEN 0 THEN 'FileNotFoundError: no order ' || o_orderkey
       WHEN 1 THEN 'shop.errors.FetchError: order ' || o_orderkey || ': gone'
       ELSE 'KeyboardInterrupt' END
    || CASE WHEN o_orderstatus = 'F' THEN {NL} || {_lines(
    "''",
    "'During handling of the above exception, another exception occurred:'",
    "''",
    "'Traceback (most recent call last):'",
    """'  File "shop/retry.py", line 9, in again'""",
    "'    raise'",
    "'RuntimeError: retry ' || o_orderkey",
)} ELSE '' END"""

SCRIPT_TEXT = f"""CASE o_orderkey % 4
    WHEN 0 THEN {_lines(
    "'TypeError: Cannot read order ' || o_orderkey",
    "'    at load (/srv/shop/cart.js:' || (o_orderkey % 50 + 1) || ':5)'",
    "'    at /srv/shop/main.js:3:1'",
    "'aside'",
    "'    at late (/srv/shop/late.js:1:1)'",
)}
    WHEN 1 THEN {_lines(
    "'RangeError: order ' || o_orderkey",
    "'a note in between'",
    "'SyntaxError'",
    "'    at parse (/srv/shop/parse.js:' || (o_custkey % 70 + 1) || ':2)'",
)}
    WHEN 2 THEN {_lines(
    "'panic: runtime error in order ' || o_orderkey",
    "''",
    "'goroutine 1 [running]:'",
    "'main.load(0x1)'",
)}
    ELSE {_lines(
    "'AError: 1'",
    "'    at a (/srv/shop/a.js:1:1)'",
    "'BError: ' || o_custkey",
    "'    at b (/srv/shop/b.js:2:2)'",
    "'CError: 3'",
    "'DError: 4'",
    "'    at d (/srv/shop/d.js:4:4)'",
)} END"""

LOG_TEXT = f"""CASE event_type
    WHEN 'error' THEN {_lines(
    "CAST(ts AS STRING) || ' ERROR [pool-' || (user_id % 7)"
    " || '] com.shop.pay.Worker - job ' || event_id || ' failed'",
    "'[main] WARN retry for user ' || user_id",
    "CAST(ts AS STRING) || ' INFO com.shop.cart.Basket: order ' || event_id",
    "'  details of the error follow'",
)}
    WHEN 'purchase' THEN {_lines(
    "CAST(ts AS STRING) || ' INFO  bought ' || props",
    "CAST(ts AS STRING) || ' DEBUG (com.shop.cart.Basket) closed'",
)}
    WHEN 'signup' THEN {_lines(
    "'[main] ERR: user ' || user_id || ' has no name'",
    "'plain text about ERROR handling'",
    "CAST(ts AS STRING) || ' WARNING] odd INFO'",
)}
    WHEN 'view' THEN {_lines(
    "'user ' || user_id || ' looked at a page'",
    "CAST(ts AS STRING) || ' NOTICE 10.0.0.' || (user_id % 200) || ' reached'",
)}
    ELSE CAST(ts AS STRING) || ' TRACE - click ' || props END"""

LOG_LINE = f"""CASE event_type
    WHEN 'error' THEN CAST(ts AS STRING) || ' ERROR com.shop.pay.Worker - job ' || event_id
    WHEN 'purchase' THEN CAST(ts AS STRING) || ' INFO bought ' || props
    WHEN 'signup' THEN '[main] WARN user ' || user_id || ' is new'
    WHEN 'view' THEN 'user ' || user_id || ' looked at a page'
    ELSE CAST(ts AS STRING) || ' DEBUG click' END"""

REPORT_TEXT = f"""CASE o_orderkey % 3
    WHEN 0 THEN {_lines(
    "'# Order ' || o_orderkey || ' is wrong'",
    "'## Steps to reproduce'",
    "'1. open order ' || o_orderkey",
    "'2. look'",
    "'## Expected'",
    "'total of customer ' || o_custkey",
    "'**Actual result**: fails with E' || (1000 + o_orderkey % 9000)",
    "'Note: kept as content'",
    "'Version: 2.' || (o_orderkey % 10)",
    "'steps: again'",
)}
    WHEN 1 THEN {_lines(
    "'Summary: order ' || o_orderkey || ' has a problem'",
    "'Environment: linux'",
    "'Observed: status ' || o_orderstatus || ' in src/order' || (o_orderkey % 20) || '.py'",
    "''",
    "'Priority: ' || o_orderpriority",
    "'Expected behavior: none'",
    "'Observed: again with HTTP 50' || (o_orderkey % 5)",
)}
    ELSE {_lines(
    "'some words about the order number ' || o_orderkey || ' that was not shipped'",
    "'the second line has also more than six words'",
    "'and a third line of text follows the others'",
)} END"""

MIXED_TEXT = f"""CASE o_orderkey % 5
    WHEN 0 THEN {JAVA_TEXT}
    WHEN 1 THEN {PYTHON_TEXT}
    WHEN 2 THEN {SCRIPT_TEXT}
    WHEN 3 THEN {REPORT_TEXT}
    ELSE {REPORT_TEXT} || {NL} || {JAVA_TEXT} END"""

# Rows of a Bugzilla export: orders with their customers.
BUGZILLA_ROWS = """
SELECT CASE WHEN o_orderkey % 50 = 7 THEN '  ' ELSE CAST(o_orderkey AS STRING) END AS bug_id,
       'Shop' AS product,
       c_mktsegment AS component,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Blocker!' WHEN '2-HIGH' THEN 'CRITICAL'
            WHEN '3-MEDIUM' THEN 'normal' WHEN '5-LOW' THEN 'new feature' ELSE '--' END
            AS bug_severity,
       CASE o_orderpriority WHEN '1-URGENT' THEN ' P1 ' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'normal' ELSE 'whenever' END AS priority,
       'Order ' || o_orderkey || ' &lt;late&gt; for ' || c_name AS short_desc,
       CASE o_orderkey % 4
            WHEN 0 THEN '<p>It fails:</p>' || chr(13) || chr(10) || 'Caused by: a.b.CError  x'
            WHEN 1 THEN 'see' || chr(9) || chr(9) || 'java.io.X' || chr(10) || chr(9)
                 || 'at com.shop.db.Pool.get(Pool.java:' || (o_custkey % 90 + 1) || ')  '
            WHEN 2 THEN NULL ELSE '  AT&amp;T said &quot;no&quot;   ' END AS description,
       CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'Reopened'
            ELSE 'UNCONFIRMED' END AS bug_status,
       CASE o_orderkey % 6 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'Duplicate' WHEN 2 THEN ''
            WHEN 3 THEN 'Won''t Fix' WHEN 4 THEN 'abandoned' ELSE 'Cannot Reproduce' END
            AS resolution,
       CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey AS STRING) ELSE '' END AS dup_id,
       CASE WHEN o_orderstatus = 'F' THEN 'Set the total of ' || c_name ELSE ' ' END
            AS resolution_note,
       c_name AS reporter,
       CAST(o_orderdate AS STRING) AS creation_ts
FROM orders JOIN customer ON o_custkey = c_custkey
"""

# Rows of a JIRA export, with dotted and renamed headers.
JIRA_ROWS = """
SELECT CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE 'SHOP-' || o_orderkey END AS key,
       CASE o_orderkey % 5 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Code  Defect' WHEN 2 THEN NULL
            WHEN 3 THEN 'Sub-bug' ELSE 'Improvement' END AS "issuetype.name",
       CASE WHEN o_orderkey % 2 = 0 THEN 'CART' ELSE '' END AS "project.key",
       'Order ' || o_orderkey AS summary,
       CASE WHEN o_orderstatus = 'F' THEN 'fails in &#39;load&#39; at line ' || o_custkey
            ELSE '' END AS "desc",
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Blocker' WHEN '2-HIGH' THEN 'Critical'
            WHEN '3-MEDIUM' THEN 'Major' WHEN '5-LOW' THEN 'Lowest' ELSE NULL END
            AS "priority.name",
       CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'In Progress'
            ELSE 'Patch Available' END AS "status.name",
       CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'Not A Bug' ELSE NULL END
            AS "resolution.name",
       CASE WHEN o_orderkey % 9 = 0 THEN 'SHOP-' || o_custkey ELSE NULL END AS dup_id,
       CAST(o_orderdate AS STRING) AS created
FROM orders
"""


def for_spark(sql: str) -> str:
    """The same SQL with Spark's quotes around column names."""
    quoted = sql
    for name in (
        "issuetype.name", "project.key", "desc", "priority.name", "status.name",
        "resolution.name",
    ):
        quoted = quoted.replace(f'"{name}"', f"`{name}`")
    return quoted.replace("Won''t", "Won\\'t")

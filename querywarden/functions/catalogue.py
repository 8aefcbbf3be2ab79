"""Rule catalogue, severity scale and policy rule book: the constants all scorers share."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: these decide the results and are stated as they must be --------------------

SEVERITY_WEIGHT = {"LOW": 0.15, "MEDIUM": 0.30, "HIGH": 0.55, "CRITICAL": 0.80}
UNKNOWN_SEVERITY_WEIGHT = 0.15
MAX_RULE_WEIGHT = 0.80

# name, pattern, flags, attack type, severity, description, literals every match contains once its
# white space is taken out (see has_needles)
_RULE_ROWS = [
    ("tautology_or_1_eq_1", r"\bOR\s+1\s*=\s*1\b", "i", "tautology", "CRITICAL",
     "Classic OR 1=1 tautology – always-true condition injection", "or1=1"),
    ("tautology_quoted_string", r"\bOR\s+'[^']*'\s*=\s*'[^']*'\b", "i", "tautology", "CRITICAL",
     "Quoted-string tautology e.g. OR 'a'='a'", "or'"),
    ("tautology_true_literal", r"\bOR\s+TRUE\b", "i", "tautology", "HIGH",
     "OR TRUE tautology", "ortrue"),
    ("tautology_and_1_eq_1", r"\bAND\s+1\s*=\s*1\b", "i", "tautology", "HIGH",
     "AND 1=1 blind-injection tautology", "and1=1"),
    ("tautology_quoted_and", r"\bAND\s+'[^']*'\s*=\s*'[^']*'\b", "i", "tautology", "HIGH",
     "Quoted-string blind-injection tautology", "and'"),
    ("comment_double_dash", r"--", "", "comment_injection", "HIGH",
     "SQL end-of-line comment (--) – used to nullify trailing WHERE clauses", "--"),
    ("comment_block", r"/\*.*?\*/", "s", "comment_injection", "HIGH",
     "SQL block comment (/* ... */) – can hide injected payload", "=/* */"),
    ("comment_hash", r"#\s", "", "comment_injection", "MEDIUM",
     "MySQL hash comment (#) – used to terminate query early", "#"),
    ("delay_sleep", r"\bSLEEP\s*\(", "i", "time_delay", "CRITICAL",
     "SLEEP() function – time-based blind injection / delay backdoor", "sleep("),
    ("delay_pg_sleep", r"\bPG_SLEEP\s*\(", "i", "time_delay", "CRITICAL",
     "PostgreSQL pg_sleep() – time-based delay", "pg_sleep("),
    ("delay_waitfor", r"\bWAITFOR\s+DELAY\b", "i", "time_delay", "CRITICAL",
     "MSSQL WAITFOR DELAY – time-based delay", "waitfordelay"),
    ("delay_benchmark", r"\bBENCHMARK\s*\(", "i", "time_delay", "HIGH",
     "MySQL BENCHMARK() – CPU-based timing attack", "benchmark("),
    ("stacked_select", r";\s*SELECT\b", "i", "piggy_back", "CRITICAL",
     "Stacked SELECT after semicolon – piggy-back query", ";select"),
    ("stacked_drop", r";\s*DROP\b", "i", "piggy_back", "CRITICAL",
     "DROP TABLE/DATABASE after semicolon – destructive piggy-back", ";drop"),
    ("stacked_insert", r";\s*INSERT\b", "i", "piggy_back", "CRITICAL",
     "INSERT after semicolon – data-manipulation piggy-back", ";insert"),
    ("stacked_update", r";\s*UPDATE\b", "i", "piggy_back", "CRITICAL",
     "UPDATE after semicolon – data-manipulation piggy-back", ";update"),
    ("stacked_delete", r";\s*DELETE\b", "i", "piggy_back", "CRITICAL",
     "DELETE after semicolon – data-destruction piggy-back", ";delete"),
    ("bare_drop", r"\bDROP\s+(TABLE|DATABASE|SCHEMA|INDEX|VIEW|PROCEDURE|FUNCTION)\b", "i",
     "piggy_back", "CRITICAL", "Bare DROP statement – destructive DDL", "drop"),
    ("bare_truncate", r"\bTRUNCATE\s+TABLE\b", "i", "piggy_back", "HIGH",
     "TRUNCATE TABLE – data-destruction", "truncatetable"),
    ("union_select_null", r"\bUNION\s+(ALL\s+)?SELECT\s+NULL\b", "i", "union_injection", "CRITICAL",
     "UNION SELECT NULL – column-count probing injection", "unionselectnull | unionallselectnull"),
    ("union_select_info_schema", r"\bUNION\s+(ALL\s+)?SELECT\b.{0,120}\binformation_schema\b", "is",
     "union_injection", "CRITICAL", "UNION SELECT ... information_schema – schema enumeration",
     "unionselect information_schema | unionallselect information_schema"),
    ("union_select_then_comment", r"\bUNION\s+(ALL\s+)?SELECT\b.{0,200}--", "is",
     "union_injection", "HIGH", "UNION SELECT followed by -- comment – trailing comment injection",
     "unionselect -- | unionallselect --"),
    ("xp_cmdshell", r"\bXP_CMDSHELL\b", "i", "rce", "CRITICAL",
     "xp_cmdshell – OS command execution via MSSQL", "xp_cmdshell"),
    ("load_file", r"\bLOAD_FILE\s*\(", "i", "file_access", "HIGH",
     "LOAD_FILE() – reads server filesystem", "load_file("),
    ("into_outfile", r"\bINTO\s+OUTFILE\b", "i", "file_access", "HIGH",
     "INTO OUTFILE – writes query result to filesystem", "intooutfile"),
]

FORBIDDEN_KEYWORDS = {
    "strict": ["DROP", "TRUNCATE", "ALTER TABLE", "CREATE TABLE", "DELETE FROM", "INSERT INTO", "UPDATE",
               "EXEC", "EXECUTE", "XP_", "SP_", "LOAD_FILE", "INTO OUTFILE", "INTO DUMPFILE",
               "SLEEP", "WAITFOR", "DELAY", "PG_SLEEP", "SHUTDOWN", "REVOKE", "GRANT"],
    "lenient": ["DROP", "TRUNCATE", "DELETE FROM", "INSERT INTO"],
}

DANGEROUS_FUNCTIONS = {
    "strict": ["xp_cmdshell", "sp_executesql", "exec", "execute", "system", "proc_open", "shell_exec",
               "mysql_query", "load_file", "benchmark", "sleep", "pg_sleep", "waitfor", "sys_exec",
               "cmd_shell", "sql_variant_property"],
    "lenient": ["xp_cmdshell", "sp_executesql", "exec", "execute"],
}

# name, pattern (ignore case, dot stops at a line end), literals as above
POLICY_PATTERNS = [
    ("comment_injection", r"(--\s*|/\*.*?\*/|#\s*)", "=-- | =# | =/* */"),
    ("tautology", r"(1\s*=\s*1|'1'\s*=\s*'1'|true\s*=\s*true)", "1=1 | '1'='1' | true=true"),
    ("union_inject",
     r"(?:union\s+(?:all\s+)?select\s+null|union\s+(?:all\s+)?select\b.{0,120}information_schema)",
     "unionselectnull | unionallselectnull | unionselect information_schema | unionallselect information_schema"),
    ("blind_injection", r"(and\s+1\s*=\s*1|and\s+'1'\s*=\s*'1')", "and1=1 | and'1'='1'"),
    ("time_delay", r"(?:sleep\s*\(|waitfor\s+delay|pg_sleep\s*\(|benchmark\s*\()",
     "sleep( | waitfordelay | benchmark("),
    ("stacked_queries", r";\s*(?:select|insert|update|delete|create|drop|alter)",
     ";select | ;insert | ;update | ;delete | ;create | ;drop | ;alter"),
    ("cartesian_product", r"cross\s+join", "crossjoin"),
    ("subquery_bomb", r"select.*?select.*?select.*?select", "select select select select"),
]

# flag and label of the suspicious patterns, in reporting order
PATTERN_LABELS = {
    "has_comment_injection": "SQL Comment detected",
    "has_tautology": "Tautology condition detected",
    "has_time_delay": "Time delay function detected",
    "has_piggy_back": "Multiple statements detected",
    "has_union_select": "UNION SELECT injection pattern detected",
}

# texts of the results
VIOLATION_KINDS = ("Forbidden keyword", "Dangerous function", "Suspicious pattern")
ANOMALIES = {
    "statements": "Multiple statements detected",
    "nesting": "Excessive nesting detected (possible subquery bomb)",
    "where": "Abnormally long WHERE clause",
    "quotes": "Unbalanced quotes detected",
}
RECOMMENDATIONS = {
    "many": "Query contains multiple policy violations - REJECT",
    "some": "Query contains policy violations - ROUTE TO SANDBOX",
    "risk": "High-risk query - Consider additional review",
    "destructive": "Data modification/destruction detected - REJECT",
    "time": "Time-based attack pattern detected - REJECT",
    "none": "Query passes policy checks",
}
PARSE_FAILED = "Failed to parse generated SQL"
INCONSISTENCIES = {
    "query_type_match": "Query type mismatch",
    "where_clause_match": "WHERE clause mismatch",
    "join_match": "JOIN clause mismatch",
}
REASON_UNPARSED = "SQL could not be parsed — possibly malformed/injected"
REASON_ALIGNMENT = ("AST alignment ", " < threshold ")
REASON_KEYWORD = ("Keyword gate: ", " → ")
REASON_STRUCTURE = "AST structural anomalies: "

# ---- end of fixed values -----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One keyword rule. ``pattern`` is in Python spelling; ``needles`` is optional, see ``has_needles``."""

    name: str
    pattern: str
    attack_type: str
    severity: str
    description: str = ""
    flags: str = "i"
    weight: float = 1.0
    needles: str = ""


BUILTIN_RULES: tuple[Rule, ...] = tuple(
    Rule(name, pattern, attack, severity, text, flags, SEVERITY_WEIGHT[severity], needles)
    for name, pattern, flags, attack, severity, text, needles in _RULE_ROWS
)

RULE_SCHEMA = (
    "rule_no INT, name STRING, pattern STRING, flags STRING, attack_type STRING, severity STRING, "
    "description STRING, weight DOUBLE"
)


def rule_table(spark, rules=BUILTIN_RULES):
    """The catalogue as a DataFrame: one row per rule, in scan order."""
    rows = [
        (i, r.name, r.pattern, r.flags, r.attack_type, r.severity, r.description, float(r.weight))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)

from codeloom.operators import search, secrets

KEY, PAT = "AKIA" + "1234567890ABCDEF", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGH1234"
OPENAI = "sk-proj-" + "abcdefghijklmnopqrstuvwxyz1234567890"
LINES = [
    f'export const awsAccessKey = "{KEY}";',
    f'export const gh = "{PAT}";',
    'export const databasePassword = "correct-horse-battery-staple";',
    'export const miniSecret = "n1neChars";',
    'export const placeholder = "your_api_key_here";',
    "export const apiKey = process.env.API_KEY;",
    "passwd: 'hunter2hunter2', access_key = 7q-w8e9r0t1",
    "api_key: loadKey()",
    "rk_live_" + "0123456789abcdefgh xoxb-" + "0123456789-abcdefgh",
    "-----BEGIN RSA " + "PRIVATE KEY-----",
    "eyJ" + "hbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl",
    "nothing here",
]


def test_every_detector(spark):
    files = spark.createDataFrame([("src/config.ts", "\n".join(LINES)), ("tests/config.test.ts", f'const token = "{OPENAI}";')], "path string, text string")
    got = [tuple(r) for r in secrets.scan(search.code_lines(files)).collect()]
    kinds = sorted((r[1], r[2], r[3], r[4], r[5], r[6]) for r in got)
    assert kinds == sorted([
        (1, "aws_access_key", "AWS access key id", "high", "high", "AKIA...CDEF"),
        (1, "sensitive_assignment", "awsAccessKey", "medium", "medium", "AKIA...CDEF"),
        (2, "github_token", "GitHub token", "high", "high", "ghp_...1234"),
        (3, "sensitive_assignment", "databasePassword", "medium", "medium", "corr...aple"),
        (4, "sensitive_assignment", "miniSecret", "medium", "medium", "[redacted]"),
        (6, "sensitive_reference", "sensitive reference", "low", "low", ""),
        (7, "sensitive_assignment", "passwd", "medium", "medium", "[redacted]"),
        (7, "sensitive_assignment", "access_key", "medium", "medium", "[redacted]"),
        (8, "sensitive_reference", "sensitive reference", "low", "low", ""),
        (9, "stripe_live_key", "Stripe live key", "high", "high", "rk_l...efgh"),
        (9, "slack_token", "Slack token", "high", "high", "xoxb...efgh"),
        (10, "private_key", "Private key marker", "high", "high", "----...----"),
        (11, "jwt", "JWT-like token", "medium", "high", "eyJh...dXJl"),
    ])
    assert {r[0] for r in got} == {"src/config.ts"} and not any(x in str(got) for x in (KEY, PAT, "correct-horse", "n1neChars", "your_api"))
    assert all(r.confidence != "low" for r in secrets.scan(search.code_lines(files), min_confidence="medium").collect())
    tests = secrets.scan(search.code_lines(files), include_tests=True, min_confidence="high").where("path LIKE 'tests/%'").collect()
    assert [r.kind for r in tests] == ["openai_key"] and OPENAI not in str(tests)
    assert secrets.totals(secrets.scan(search.code_lines(files))).first().asDict() == {"findings": 13, "high": 5, "medium": 6, "low": 2, "files": 1}

"""Fixed values of the domain: label names, identifiers, score tables and text patterns.

They are facts that results depend on and are written down as they are; nothing here is logic.
"""

# Labels in model order; "safe" is the negative class.
LABELS = ["CWE-89", "CWE-78", "CWE-22", "CWE-79", "CWE-94", "CWE-918", "CWE-502", "safe"]
TARGETS = LABELS[:-1]
SPLITS = ["train", "val", "test"]

CLASS_SLUGS = {
    "CWE-89": "sql_injection",
    "CWE-78": "command_injection",
    "CWE-22": "path_traversal",
    "CWE-79": "cross_site_scripting",
    "CWE-94": "code_injection",
    "CWE-918": "ssrf",
    "CWE-502": "insecure_deserialization",
}

# Raw class numbers and the target they are folded onto.
FOLD = {
    "22": "CWE-22", "23": "CWE-22", "35": "CWE-22", "36": "CWE-22",
    "77": "CWE-78", "78": "CWE-78",
    "79": "CWE-79", "80": "CWE-79", "81": "CWE-79", "83": "CWE-79", "87": "CWE-79",
    "89": "CWE-89", "564": "CWE-89",
    "94": "CWE-94", "95": "CWE-94", "96": "CWE-94",
    "502": "CWE-502",
    "918": "CWE-918",
}

# Scanner rule numbers and the class that they report.
RULES = {
    "B608": "CWE-89", "B610": "CWE-89", "B611": "CWE-89",
    "B308": "CWE-79", "B701": "CWE-79", "B702": "CWE-79", "B703": "CWE-79", "B704": "CWE-79",
    "B602": "CWE-78", "B603": "CWE-78", "B604": "CWE-78", "B605": "CWE-78", "B606": "CWE-78", "B607": "CWE-78", "B609": "CWE-78",
    "B102": "CWE-94", "B307": "CWE-94",
    "B301": "CWE-502", "B302": "CWE-502", "B506": "CWE-502",
    "B310": "CWE-918",
}

# Edges (child, parent) of the class tree.
TREE = [
    ("707", "ROOT"), ("664", "ROOT"), ("74", "707"), ("77", "74"), ("78", "77"), ("79", "74"), ("89", "74"), ("94", "74"),
    ("668", "664"), ("913", "664"), ("441", "664"), ("22", "668"), ("502", "913"), ("918", "441"),
]

# Severity words and their score; loss weights of confidence words.
MIDPOINTS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "NONE": 0.0}
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.3, "low": 0.1}

# CVSS 3.1 metric letters and weights, from the public specification.
CVSS_LETTERS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "NLH", "I": "NLH", "A": "NLH"}
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"N": 0.0, "L": 0.22, "H": 0.56},
    "I": {"N": 0.0, "L": 0.22, "H": 0.56},
    "A": {"N": 0.0, "L": 0.22, "H": 0.56},
}
CVSS_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
CVSS_WORDS = {
    "AV": {"N": "NETWORK", "A": "ADJACENT", "L": "LOCAL", "P": "PHYSICAL"},
    "AC": {"L": "LOW", "H": "HIGH"},
    "PR": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "UI": {"N": "NONE", "R": "REQUIRED"},
    "S": {"U": "UNCHANGED", "C": "CHANGED"},
    "C": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "I": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "A": {"N": "NONE", "L": "LOW", "H": "HIGH"},
}

# Augmentation multipliers per class; other classes have 1.
MULTIPLIERS = {"CWE-502": 8.0, "CWE-918": 4.0, "CWE-94": 4.0, "CWE-78": 2.0}

# Variants of the test set and the single mutators among them.
MUTATORS = ["dead_code_injection", "string_split", "variable_rename", "wrapper_extraction", "sink_attr_obfuscate", "sink_via_globals", "taint_through_dict"]
VARIANTS = ["clean", *MUTATORS, "composed"]

# (source, class) pairs that are known to be mislabelled, and gates per class.
BLOCKED = [("vudenc", "CWE-94")]
TEST_EXCLUDED = ["CWE-79"]
NEEDS_REQUEST = ["CWE-22"]

# Web frameworks, in the order in which they are looked for.
FRAMEWORKS = {
    "flask": r"(?i)(from flask\b|import flask\b)",
    "django": r"(?i)(from django\b|import django\b|django\.http|django\.views)",
    "fastapi": r"(?i)(from fastapi\b|import fastapi\b)",
    "starlette": r"(?i)(from starlette\b|import starlette\b)",
    "aiohttp": r"(?i)(from aiohttp\b|import aiohttp\b)",
    "tornado": r"(?i)(from tornado\b|import tornado\b)",
    "bottle": r"(?i)(from bottle\b|import bottle\b)",
    "quart": r"(?i)(from quart\b|import quart\b)",
}
REQUEST_TAINT = r"(?i)(request\.(args|form|data|json|values|files|cookies|headers|GET|POST)|HttpRequest|web\.Request|self\.request)"
TAINT_SOURCE = r"(?i)request\s*\.\s*(args|form|data|json|values|files|cookies|headers|GET|POST)"
TAINT_AUDIT = r"(?i)request\s*\.\s*(args|form|data|json|values|files|cookies|headers)"
REQUEST_NEAR = r"(?i)\brequest\.(args|form|data|json|values|files|cookies|headers|GET|POST|query_params|path_params|body)\b|\bHttpRequest\b|\bweb\.Request\b|\bself\.request\b|\bawait\s+\w+\.read\s*\("
SECURITY_NEAR = r"(?i)(\bauth(?:n|z|orize|enticate|orization|enticated)?\b|password|passwd|credential|session|token(?!iz)|\blog(?:in|out)\b|\bsign(?:in|up|ed|ing|ature|er)\b|secret|verify|hmac|jwt|oauth|saml|ldap|api[_-]?key|csrf|nonce|salt|encrypt|decrypt|cipher|permission)"
SUPPRESSED = r"(?i)#\s*(noqa\s*:\s*S311|nosec\b)"
TEST_PATH = r"(?i)(^|/)(tests?|test_[^/]+|[^/]+_test|examples?|docs?|fixtures?|benchmarks?|samples?|demo|conftest\.py$)/"

# What must stand in a file for its label to be believed, in order.
SINKS = {
    "CWE-89": [
        r"(?i)\.execute(?:many|script)?\s*\(",
        r"(?i)\btext\s*\(\s*['\"f]",
        r"(?i)\.raw\s*\(\s*['\"f]",
        r"(?i)\bSELECT\b.*\bFROM\b",
        r"(?i)\b(INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM)\b",
        r"(?i)\bcursor\b",
        r"(?i)\bdb\.\w+\s*\(",
    ],
    "CWE-79": [
        r"\|\s*safe\b",
        r"(?i)\bmark_safe\s*\(",
        r"(?i)\bMarkup\s*\(",
        r"(?i)\brender_template_string\s*\(",
        r"(?i)\bautoescape\s*=\s*False",
        r"\.innerHTML\b",
        r"(?i)\brender_template\s*\(",
        r"(?i)\brender\s*\(\s*request",
        r"(?i)\bHttpResponse\s*\(",
        r"(?i)\bself\.write\s*\(",
        r"(?i)\bweb\.Response\s*\(",
    ],
    "CWE-78": [
        r"(?i)\bos\.(system|popen|spawn[lpvP])\s*\(",
        r"(?is)\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True",
        r"(?i)\bcommands\.(getoutput|getstatusoutput)\s*\(",
        r"(?i)\bPopen\s*\(",
    ],
    "CWE-22": [
        r"(?i)\bopen\s*\(",
        r"(?i)\bsend_file\s*\(",
        r"(?i)\bsend_from_directory\s*\(",
        r"(?i)\bos\.path\.join\s*\(",
        r"(?i)\bPath\s*\(",
        r"(?i)\.\./\.\.",
    ],
    "CWE-918": [
        r"(?i)\brequests\.(get|post|put|delete|head|options|patch|request)\s*\(",
        r"(?i)\burllib\.request\.urlopen\s*\(",
        r"(?i)\burlopen\s*\(",
        r"(?i)\bhttpx\.\w+\s*\(",
        r"(?i)\baiohttp\.\w+\s*\(",
    ],
    "CWE-502": [
        r"(?i)\bpickle\.loads?\s*\(",
        r"(?i)\bcPickle\.loads?\s*\(",
        r"(?i)\byaml\.load\s*\((?!.*safe_load)",
        r"(?i)\byaml\.unsafe_load\s*\(",
        r"(?i)\bmarshal\.loads?\s*\(",
        r"\bdef\s+__reduce__\s*\(",
        r"(?i)\bshelve\.(open|load)\s*\(",
        r"(?i)\bjsonpickle\.(decode|loads)\s*\(",
    ],
    "CWE-94": [
        r"(?i)\beval\s*\(",
        r"(?i)\bexec\s*\(",
        r"(?i)\b__import__\s*\(",
        r"(?i)\bimportlib\.import_module\b",
    ],
}

# Patterns of four kinds of unsafe snippets, in order, and of their safe forms.
UNSAFE = {
    "sql_injection": [
        r"(?i)execute\s*\(\s*f[\"']",
        r"(?is)execute\s*\(.*?[+%].*?request",
        r"(?is)execute\s*\(.*?\.format\s*\(",
        r"(?is)(SELECT|INSERT|UPDATE|DELETE).*?[+%].*?request",
        r"(?is)text\s*\(\s*f[\"'].*?(SELECT|INSERT|UPDATE|DELETE)",
        r"(?is)text\s*\(.*?(SELECT|INSERT|UPDATE|DELETE).*?[+%\{]",
    ],
    "command_injection": [
        r"(?i)os\.(system|popen)\s*\(",
        r"(?is)subprocess\.(run|call|check_call|check_output|Popen)\s*\(.*?shell\s*=\s*True",
        r"(?i)eval\s*\(\s*request",
        r"(?i)exec\s*\(\s*request",
    ],
    "path_traversal": [
        r"(?is)open\s*\(.*?request",
        r"(?is)send_file\s*\(.*?request",
        r"(?is)os\.path\.join\s*\(.*?request",
        r"(?is)send_from_directory\s*\(.*?request",
        r"(?is)Path\s*\(.*?request",
    ],
    "insecure_deserialization": [
        r"(?i)pickle\.loads?\s*\(",
        r"(?i)yaml\.load\s*\(\s*(?!.*safe_load)",
        r"(?i)marshal\.loads?\s*\(",
    ],
}
SECURE = {
    "sql_injection": [
        r"(?i)execute\s*\(\s*[\"'].*?[\"'],\s*\(",
        r"(?i)execute\s*\(\s*[\"'].*?%s[\"'],",
        r"(?i)filter_by\s*\(",
        r"(?i)filter\s*\(.*?==",
    ],
    "command_injection": [r"(?i)shlex\.quote\s*\(", r"(?i)subprocess\.(run|call|Popen)\s*\(\s*\["],
    "path_traversal": [r"(?i)secure_filename\s*\(", r"(?i)safe_join\s*\("],
    "insecure_deserialization": [r"(?i)yaml\.safe_load\s*\(", r"(?is)json\.loads?\s*\(.*?request"],
}

# What supports a label at all, for purging.
SUPPORT = {
    "CWE-89": [
        r"(?i)execute\s*\(\s*f[\"']",
        r"(?i)execute\s*\(\s*[\"'][^\"']*%\s*",
        r"(?i)execute\s*\(\s*[\"'][^\"']*\+",
        r"(?i)execute\s*\(\s*.*\.format\s*\(",
        r"(?i)execute\s*\(\s*(query|sql|stmt)\b",
        r"(?i)(query|sql|stmt)\s*=\s*f[\"']",
        r"(?i)(query|sql|stmt)\s*=\s*[\"'][^\"']*\+",
        r"(?i)(query|sql|stmt)\s*=\s*.*\.format\s*\(",
        r"(?i)filter\s*\(\s*f[\"']",
        r"(?i)\.raw\s*\(\s*f[\"']",
        r"(?i)text\s*\(\s*f[\"']",
        r"(?i)text\s*\(\s*[\"'][^\"']*\+",
    ],
    "CWE-78": [r"\bos\s*\.\s*(system|popen)\s*\(", r"\bsubprocess\s*\.\s*(run|call|check_output|Popen)\s*\(", r"\beval\s*\(", r"\bexec\s*\("],
    "CWE-22": [r"\bopen\s*\(", r"\bsend_file\s*\(", r"\bsend_from_directory\s*\(", r"\bos\s*\.\s*path\s*\.\s*(join|abspath)\s*\("],
    "CWE-502": [r"\bpickle\s*\.\s*loads?\s*\(", r"\byaml\s*\.\s*load\s*\(", r"\bmarshal\s*\.\s*loads?\s*\("],
    "CWE-79": [r"\bmark_safe\s*\(", r"\bMarkup\s*\(", r"\brender_template_string\s*\(", r"autoescape\s*=\s*False", r"\|safe\b"],
    "CWE-94": [r"\beval\s*\(", r"\bexec\s*\(", r"\bcompile\s*\(", r"\b__import__\s*\("],
    "CWE-918": [
        r"\brequests\s*\.\s*(get|post|put|patch|delete|head|request)\s*\(",
        r"\burllib\.request\.(urlopen|Request)\s*\(",
        r"\bhttpx\s*\.\s*(get|post|put|patch|delete)\s*\(",
        r"\baiohttp\s*\.\s*ClientSession\s*\(",
    ],
}

# What the health audit looks for in a row's code, by signal.
AUDIT = {
    "sql_execute": [r"(?i)\.execute\s*\("],
    "sql_inline": [
        r"(?i)execute\s*\(\s*f[\"']",
        r"(?i)execute\s*\(\s*[\"'][^\"']*%\s*",
        r"(?i)execute\s*\(\s*[\"'][^\"']*\+",
        r"(?i)execute\s*\(\s*.*\.format\s*\(",
        r"(?i)execute\s*\(\s*(query|sql|stmt|cmd)\b",
    ],
    "sql_multiline": [
        r"(?i)(query|sql|stmt)\s*=\s*f[\"']",
        r"(?i)(query|sql|stmt)\s*=\s*[\"'][^\"']*\+",
        r"(?i)(query|sql|stmt)\s*.*\+=\s*",
        r"(?i)(query|sql|stmt)\s*=\s*.*\.format\s*\(",
        r"(?i)(query|sql|stmt)\s*=\s*[\"'][^\"']*%\s*",
        r"(?i)(query|sql|stmt)\s*=\s*\"[^\"]*\"\s*\+\s*\w",
    ],
    "sql_orm": [
        r"(?i)filter\s*\(\s*[\"'].*%",
        r"(?i)filter\s*\(\s*f[\"']",
        r"(?i)\.raw\s*\(\s*f[\"']",
        r"(?i)\.raw\s*\(\s*[\"'][^\"']*%",
        r"(?i)text\s*\(\s*f[\"']",
        r"(?i)text\s*\(\s*[\"'][^\"']*\+",
    ],
    "sql_keywords": [r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP)\b"],
    "command_call": [
        r"\bos\s*\.\s*system\s*\(",
        r"\bos\s*\.\s*popen\s*\(",
        r"\bsubprocess\s*\.\s*(run|call|check_output|Popen)\s*\(",
        r"\bcommands\s*\.\s*getoutput\s*\(",
        r"\beval\s*\(",
        r"\bexec\s*\(",
    ],
    "shell_true": [r"shell\s*=\s*True"],
    "eval_exec": [r"\beval\s*\(|\bexec\s*\("],
    "file_operation": [
        r"\bopen\s*\(",
        r"\bsend_file\s*\(",
        r"\bsend_from_directory\s*\(",
        r"\bos\s*\.\s*path\s*\.\s*(join|abspath|realpath)\s*\(",
        r"\bPathlib|Path\(",
    ],
    "traversal_hint": [r"(?i)\.\./|%2e%2e|\\\\\.\\\\"],
    "deserialization": [
        r"\bpickle\s*\.\s*loads?\s*\(",
        r"\byaml\s*\.\s*load\s*\(",
        r"\bjson\s*\.\s*loads?\s*\(",
        r"\bmarshal\s*\.\s*loads?\s*\(",
        r"\bshelve\s*\.",
        r"\bcPickle\s*\.\s*loads?\s*\(",
    ],
    "raw_deserialization": [r"\bpickle\s*\.\s*loads?\s*\(", r"\bmarshal\s*\.\s*loads?\s*\("],
    "yaml_load": [r"\byaml\s*\.\s*load\s*\("],
    "safe_yaml": [r"yaml\.safe_load\s*\("],
    "xss_sink": [
        r"\bmark_safe\s*\(",
        r"\bMarkup\s*\(",
        r"\brender_template_string\s*\(",
        r"(?s)\bformat_html\s*\(.*%s",
        r"autoescape\s*=\s*False",
        r"\|safe\b",
    ],
    "dynamic_exec": [
        r"\beval\s*\(",
        r"\bexec\s*\(",
        r"\bcompile\s*\(",
        r"\b__import__\s*\(",
        r"\bimportlib\.import_module\s*\(",
    ],
    "http_call": [
        r"\brequests\s*\.\s*(get|post|put|patch|delete|head|request)\s*\(",
        r"\burllib\.request\.(urlopen|Request)\s*\(",
        r"\bhttpx\s*\.\s*(get|post|put|patch|delete|AsyncClient)\s*\(",
        r"\baiohttp\s*\.\s*ClientSession\s*\(",
        r"\bhttp\.client\.(HTTPConnection|HTTPSConnection)\s*\(",
    ],
}
AUDIT_FLASK = r"(?i)(from flask|import flask)"
AUDIT_ROUTE = r"@\w+\.(route|get|post|put|delete|patch)\s*\("
AUDIT_ATTACK = [r"\brequests\.(get|post|put)\s*\(", r"\bsocket\.(connect|send)\s*\(", r"(?i)exploit|payload|target_url|victim"]

# Literal credentials: the assignment that is looked for, and the environment name that the first hint in its key gives.
CREDENTIAL = r"(?i)(?P<key>password|passwd|secret(?:_key)?|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|aws_(?:secret|access)[_-]?key)(?P<eq>\s*=\s*)(?P<val>['\"][^'\"\s][^'\"]{5,}['\"])"
CREDENTIAL_NAMES = {
    "password": "PASSWORD", "passwd": "PASSWORD", "secret": "SECRET", "api_key": "API_KEY", "apikey": "API_KEY", "access_token": "ACCESS_TOKEN", "auth_token": "AUTH_TOKEN",
    "token": "TOKEN", "client_secret": "CLIENT_SECRET", "private_key": "PRIVATE_KEY", "aws_secret": "AWS_SECRET_ACCESS_KEY", "aws_access": "AWS_ACCESS_KEY_ID",
}
CREDENTIAL_DEFAULT = "SECRET"

# Other names that a renamed variable may get.
SYNONYMS = {
    "user": ["visitor", "login_user"], "username": ["user_label", "login_name"], "password": ["pass_text", "pw"], "name": ["caption", "given_name"], "uid": ["user_no", "user_key"],
    "query": ["statement", "sql_text"], "sql": ["statement", "query_text"], "cursor": ["cur_handle", "db_cursor"], "conn": ["db_link", "connection"], "rows": ["records", "found_rows"], "row": ["record", "entry"],
    "cmd": ["command", "shell_line"], "command": ["cmd_text", "instruction"], "args": ["arguments", "arg_list"], "output": ["printed", "out_text"],
    "path": ["location", "file_path"], "filename": ["file_label", "source_file"], "f": ["handle", "stream"], "fp": ["handle", "stream"],
    "url": ["address", "link"], "host": ["server_name", "machine"], "response": ["answer", "reply"], "resp": ["answer", "reply"], "data": ["content", "blob"], "payload": ["body", "message"], "raw": ["source_bytes", "unparsed"],
    "result": ["outcome", "produced"], "value": ["amount", "held"], "key": ["lookup_key", "slot"], "item": ["element", "piece"], "items": ["elements", "pieces"], "text": ["words", "passage"], "msg": ["note", "message"],
    "i": ["position", "at"], "n": ["number", "how_many"], "x": ["value_x", "left_side"], "y": ["value_y", "right_side"],
}

# Names of calls that transforms look for first, by class.
SINK_CALLS = {
    "CWE-89": ["execute", "executemany", "executescript", "raw", "text", "filter"],
    "CWE-78": ["system", "popen", "run", "call", "check_output", "Popen"],
    "CWE-22": ["open", "send_file", "send_from_directory"],
    "CWE-79": ["Markup", "mark_safe", "render_template_string"],
    "CWE-94": ["eval", "exec", "compile", "import_module"],
    "CWE-918": ["get", "post", "put", "patch", "delete", "head", "request", "urlopen", "Request"],
    "CWE-502": ["loads", "load", "full_load", "unsafe_load"],
}

# Calls that transforms hide, as module and function; functions that are sinks whatever object they belong to; built-in ones.
HIDDEN_CALLS = {
    "os": ["system", "popen", "spawnl", "spawnle", "spawnlp", "spawnlpe", "spawnv", "spawnve", "spawnvp", "spawnvpe"],
    "subprocess": ["call", "run", "Popen", "check_call", "check_output", "getoutput", "getstatusoutput"],
    "commands": ["getoutput", "getstatusoutput"],
    "requests": ["get", "post", "put", "patch", "delete", "head", "options", "request"],
    "urllib": ["urlopen"],
    "urllib2": ["urlopen"],
    "httpx": ["get", "post", "put", "patch", "delete"],
    "pickle": ["load", "loads"],
    "cPickle": ["load", "loads"],
    "dill": ["load", "loads"],
    "yaml": ["load", "load_all", "unsafe_load", "unsafe_load_all"],
    "marshal": ["load", "loads"],
    "shelve": ["open"],
}
HIDDEN_METHODS = ["execute", "executemany", "executescript", "raw"]
HIDDEN_BUILTINS = ["eval", "exec", "compile", "__import__"]

# The label that a loss leaves out.
IGNORE_INDEX = -100

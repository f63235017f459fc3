"""Fixed values of extraction: what declarations, imports, routes and calls look like in each language."""

from __future__ import annotations

import re


def _compiled(table: dict[str, list], flags: int = re.MULTILINE | re.ASCII) -> dict[str, list]:
    return {k: [(*x[:-1], re.compile(x[-1], flags)) if isinstance(x, tuple) else re.compile(x, flags) for x in v] for k, v in table.items()}


# Kinds and declaration patterns by language; group "name" names the symbol, group "exported" marks exported ones.
_ID, _W = r"(?P<name>[A-Za-z_$][\w$]*)", r"(?P<name>[A-Za-z_]\w*)"
_SCRIPT_FUNCTIONS = [
    ("function", r"^\s*(?P<exported>export\s+)?(?:async\s+)?function\s+" + _ID),
    ("function", r"^\s*(?P<exported>export\s+)?const\s+" + _ID + r"\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
]
_CS = r"^\s*(?:\[[^\]\n]+\]\s*)*"
DECLARATIONS = _compiled({
    "typescript": [("class", r"^\s*(?P<exported>export\s+)?(?:abstract\s+)?class\s+" + _ID), ("interface", r"^\s*(?P<exported>export\s+)?interface\s+" + _ID), ("type", r"^\s*(?P<exported>export\s+)?type\s+" + _ID), *_SCRIPT_FUNCTIONS],
    "javascript": [("class", r"^\s*(?P<exported>export\s+)?class\s+" + _ID), *_SCRIPT_FUNCTIONS],
    "python": [("class", r"^\s*class\s+" + _W), ("function", r"^\s*(?:async\s+)?def\s+" + _W)],
    "go": [("function", r"^func\s+(?:\([^)]+\)\s*)?" + _W), ("type", r"^type\s+" + _W + r"\s+(?:struct|interface)")],
    "java": [
        ("class", r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)?class\s+" + _W),
        ("interface", r"^\s*(?:public|private|protected)?\s*interface\s+" + _W),
        ("method", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\], ?]+\s+" + _W + r"\s*\([^;]*\)\s*\{"),
    ],
    "rust": [(kind, r"^\s*(?:pub\s+)?" + word + r"\s+" + _W) for kind, word in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"))],
    "swift": [
        ("class", r"^\s*(?:public|open|internal|private|fileprivate|final|\s)*class\s+" + _W),
        *((kind, r"^\s*(?:public|internal|private|fileprivate|\s)*" + kind + r"\s+" + _W) for kind in ("struct", "enum", "protocol")),
        ("actor", r"^\s*(?:public|open|internal|private|fileprivate|final|\s)*actor\s+" + _W),
        ("function", r"^\s*(?:public|open|internal|private|fileprivate|static|class|mutating|nonisolated|override|async|\s)*func\s+" + _W),
    ],
    "c": [
        ("struct", r"^\s*(?:typedef\s+)?struct\s+" + _W), ("enum", r"^\s*(?:typedef\s+)?enum\s+" + _W),
        ("function", r"^\s*(?:(?:static|inline|extern)\s+)*(?:[A-Za-z_]\w*[&*]?\s+){1,8}" + _W + r"\s*\([^;{}]*\)\s*\{"),
    ],
    "cpp": [
        ("namespace", r"^\s*namespace\s+" + _W + r"\s*\{"),
        *((kind, r"^\s*(?:template\s*<[^>]+>\s*)?" + kind + r"\s+" + _W) for kind in ("class", "struct")),
        ("enum", r"^\s*(?:enum\s+(?:class\s+)?)\s*" + _W),
        ("function", r"^\s*(?:template\s*<[^>\n]+>\s*)?(?:(?:static|inline|virtual|constexpr|extern|friend|const)\s+)*(?:[A-Za-z_~][\w:<>]*[&*]?\s+){1,8}(?:(?:[A-Za-z_]\w*)::)?(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:final\s*)?\{"),
    ],
    "csharp": [
        ("class", _CS + r"(?:(?:public|private|protected|internal|abstract|sealed|static|partial)\s+)*class\s+" + _W),
        ("interface", _CS + r"(?:(?:public|private|protected|internal|partial)\s+)*interface\s+" + _W),
        ("struct", _CS + r"(?:(?:public|private|protected|internal|readonly|partial)\s+)*struct\s+" + _W),
        ("enum", _CS + r"(?:(?:public|private|protected|internal)\s+)*enum\s+" + _W),
        ("record", _CS + r"(?:(?:public|private|protected|internal|sealed|abstract|partial)\s+)*record(?:\s+class|\s+struct)?\s+" + _W),
        ("method", _CS + r"(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|partial|extern|unsafe)\s+)+[\w<>\[\],?]+\s+" + _W + r"\s*\([^;{}]*\)\s*(?:where\s+[^{]+)?\{"),
    ],
    "kotlin": [
        ("class", r"^\s*(?:(?:data|sealed|open|abstract|inner|value)\s+)*class\s+" + _W), ("interface", r"^\s*(?:fun\s+)?interface\s+" + _W),
        ("object", r"^\s*(?:data\s+)?object\s+" + _W), ("enum", r"^\s*enum\s+class\s+" + _W),
        ("function", r"^\s*(?:(?:public|private|protected|internal|suspend|inline|tailrec|operator|override|open)\s+)*fun(?:\s+<[^>]+>)?\s+" + _W),
    ],
    "php": [
        ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+" + _W), ("interface", r"^\s*interface\s+" + _W), ("trait", r"^\s*trait\s+" + _W),
        ("method", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)+function\s+" + _W), ("function", r"^\s*function\s+" + _W),
    ],
    "dart": [
        ("class", r"^\s*(?:abstract\s+|base\s+|final\s+|interface\s+|sealed\s+)?class\s+" + _W), ("mixin", r"^\s*mixin\s+" + _W), ("enum", r"^\s*enum\s+" + _W), ("extension", r"^\s*extension\s+" + _W),
        ("function", r"^\s*(?:[A-Za-z_][\w<>?,\s]*\s+)?" + _W + r"\s*\([^;{}]*\)\s*(?:async\s*)?\{"),
    ],
    "ruby": [
        ("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"), ("module", r"^\s*module\s+(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"),
        ("function", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[!?=]?)"),
    ],
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[A-Z][\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>[A-Za-z_][\w?!]*)"), ("macro", r"^\s*defmacro\s+(?P<name>[A-Za-z_][\w?!]*)")],
    "qml": [("component", r"^\s*component\s+" + _W + r"\s*:"), ("property", r"^\s*property\s+[A-Za-z_][\w<>.]*\s+" + _W), ("signal", r"^\s*signal\s+" + _W), ("function", r"^\s*function\s+" + _W)],
    "apex": [
        ("class", r"^\s*(?:(?:public|private|global|virtual|abstract|with\s+sharing|without\s+sharing|inherited\s+sharing)\s+)*class\s+" + _W),
        ("interface", r"^\s*(?:(?:public|private|global)\s+)*interface\s+" + _W), ("trigger", r"^\s*trigger\s+" + _W + r"\s+on\s+[A-Za-z_]\w*"),
        ("method", r"^\s*(?:(?:public|private|protected|global|static|override|virtual|abstract|testMethod)\s+)+[\w<>\[\],]+\s+" + _W + r"\s*\([^;{}]*\)\s*\{"),
    ],
})
NOT_NAMES = frozenset("catch do else for foreach function if new return switch try using while".split())
NOT_CALLABLE = frozenset("get post put patch delete options head json data body map filter reduce foreach render".split())
RESERVED_METHODS = frozenset("constructor if for while switch catch function return".split())
METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::\s*[^{};]+)?\{", re.M | re.A)

# Imports by language; the first group that matched is the import.
_SCRIPT_IMPORTS = [r"""from\s+["']([^"']+)["']""", r"""import\s*\(\s*["']([^"']+)["']\s*\)""", r"""require\(\s*["']([^"']+)["']\s*\)"""]
_INCLUDE = r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]"""
IMPORTS = _compiled({
    "typescript": _SCRIPT_IMPORTS, "javascript": _SCRIPT_IMPORTS,
    "python": [r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"], "go": [r'^\s*import\s+(?:"([^"]+)"|`([^`]+)`)'],
    "java": [r"^\s*import\s+([\w.*]+);"], "rust": [r"^\s*use\s+([^;]+);"], "swift": [r"^\s*import\s+([A-Za-z_][\w.]*)"],
    "c": [_INCLUDE], "cpp": [_INCLUDE, r"^\s*import\s+([A-Za-z_][\w.:]*)\s*;"], "csharp": [r"^\s*using\s+(?:static\s+)?([A-Za-z_][\w.]*);"],
    "kotlin": [r"^\s*import\s+([A-Za-z_][\w.*]*)"], "php": [r"^\s*use\s+([^;]+);", r"""\b(?:require|require_once|include|include_once)\s*\(?\s*["']([^"']+)["']"""],
    "dart": [r"""^\s*(?:import|export|part)\s+["']([^"']+)["']"""], "ruby": [r"""^\s*require(?:_relative)?\s+["']([^"']+)["']"""],
    "elixir": [r"^\s*(?:alias|import|require|use)\s+([A-Z][\w.]+)"], "qml": [r"^\s*import\s+([A-Za-z_][\w.]*)"], "apex": [r"^\s*import\s+([\w.*]+);"],
})

# Routes.
ROUTE_LANGUAGES = frozenset("typescript javascript python java go php csharp kotlin apex".split())
ROUTES = [
    re.compile(r"""\b(?:app|router|server)\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]""", re.I | re.A),
    re.compile(r"""\bRoute::(get|post|put|patch|delete|options|any)\(\s*["']([^"']+)["']""", re.I | re.A),
    re.compile(r"""\b(MapGet|MapPost|MapPut|MapPatch|MapDelete|MapMethods)\(\s*["']([^"']+)["']""", re.A),
    re.compile(r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?["']?([^"')]+)?["']?\s*\)""", re.A),
    re.compile(r"""@(Get|Post|Put|Patch|Delete|RequestMapping)\(\s*["']?([^"')]+)?["']?\s*\)""", re.A),
    re.compile(r"""\[(HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete|Route)\(\s*["']?([^"')\]]+)?["']?\s*\)\s*\]""", re.A),
    re.compile(r"""@(?:app|router)\.route\(\s*["']([^"']+)["']""", re.A),
]
APP_ROUTER = re.compile(r"(?:^|/)app/api(?:/(.+))?/route\.[cm]?[jt]sx?$")
APP_METHOD = re.compile(r"^\s*export\s+(?:(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(|const\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*=)", re.M | re.A)
OPENAPI_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE")
OPENAPI = re.compile(r'^\s*(?:openapi|swagger)\s*[:=]|"(?:openapi|swagger)"\s*:', re.I | re.M)

# Channels (edge type, pattern name, pattern); Swift has its own.
CHANNELS = [
    ("EMITS", "emit", re.compile(r"""\b(?:[\w$]+\.)?(?:emit|publish)\(\s*["'`]([^"'`]+)["'`]""", re.A)),
    ("EMITS", "custom-event", re.compile(r"""\bdispatchEvent\(\s*new\s+CustomEvent\(\s*["'`]([^"'`]+)["'`]""", re.A)),
    ("LISTENS_ON", "listener", re.compile(r"""\b(?:[\w$]+\.)?(?:on|once|addListener|subscribe)\(\s*["'`]([^"'`]+)["'`]""", re.A)),
    ("LISTENS_ON", "dom-listener", re.compile(r"""\baddEventListener\(\s*["'`]([^"'`]+)["'`]""", re.A)),
    ("LISTENS_ON", "decorator-listener", re.compile(r"""@(?:[\w.]+\.)?on\(\s*["'`]([^"'`]+)["'`]\s*\)""", re.A)),
]
_NAMED = r"""\s*:\s*(?:\.([A-Za-z_]\w*)|(?:Notification|NSNotification)\.Name\(\s*"([^"]+)"\s*\))"""
SWIFT_CHANNELS = [
    ("EMITS", "notification-post", re.compile(r"NotificationCenter\.default\.post\([\s\S]{0,180}?\bname" + _NAMED, re.A)),
    ("LISTENS_ON", "notification-listener", re.compile(r"NotificationCenter\.default\.addObserver\([\s\S]{0,220}?\b(?:name|forName)" + _NAMED, re.A)),
]

# HTTP calls, protocols, documents, SQL, Terraform.
FETCH = re.compile(r"""\bfetch\(\s*["'`]([^"'`]+)["'`]""", re.I | re.A)
FETCH_METHOD = re.compile(r"""\bmethod\s*:\s*["'`](GET|POST|PUT|PATCH|DELETE)["'`]""", re.I | re.A)
FETCH_WINDOW = 360
CLIENTS = [re.compile(r"""\baxios\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]""", re.I | re.A), re.compile(r"""\b(?:http|https)\.(get|request)\(\s*["'`]([^"'`]+)["'`]""", re.I | re.A)]
GRAPHQL_TEMPLATE = re.compile(r"\b(?:gql|graphql)\s*`([\s\S]*?)`", re.A)
GRAPHQL_OPERATION = re.compile(r"\b(query|mutation|subscription)\s+([A-Za-z_][\w]*)?", re.A)
GRAPHQL_TYPE = re.compile(r"^\s*(type|input|interface|enum|scalar)\s+([A-Za-z_][\w]*)", re.M | re.A)
PROTO_SERVICE = re.compile(r"\s*service\s+([A-Za-z_]\w*)\s*\{?", re.A)
PROTO_RPC = re.compile(r"\s*rpc\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s+returns\s+\(([^)]*)\)", re.A)
TRPC_BUILDER = re.compile(r"(?<![\w$])(?:publicProcedure|protectedProcedure|adminProcedure|procedure)(?![\w$])", re.A)
TRPC_CALL = re.compile(r"\b(?:trpc|api)\.([A-Za-z_$][\w$.]*)\.(useQuery|useMutation|query|mutate|mutation)\s*\(", re.A)
HEADING = re.compile(r"(#{1,6})\s+(.+)")
DDL = re.compile(r"\bCREATE\s+(TABLE|VIEW|INDEX|FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][\w.]*)", re.I | re.A)
TERRAFORM = re.compile(r'^\s*(?:(resource|data)\s+"([^"]+)"\s+"([^"]+)"|(module|variable|output|provider)\s+"([^"]+)")\s*\{', re.M | re.A)
GRADLE_DEPENDENCY = re.compile(r"""^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)\s*(?:\(?\s*)["']([^:"']+):([^:"']+):?([^"']*)["']""", re.M | re.A)
BLOCK_OPENERS = {
    "ruby": re.compile(r"\s*(?:class|module|def|if|unless|case|begin|while|until|for)\b|.*\bdo\s*(?:\|[^|]*\|)?\s*(?:#.*)?$", re.A),
    "elixir": re.compile(r"\s*(?:defmodule|defp?|defmacro|if|unless|case|cond|try|receive|for|with|fn)\b", re.A),
}

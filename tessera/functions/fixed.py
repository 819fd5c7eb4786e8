"""Fixed values that results depend on: word lists, extensions, thresholds. All are data, none is logic."""

# Extension -> language.
EXTENSION_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp",
    "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "vue": "vue", "svelte": "svelte", "astro": "astro", "graphql": "graphql", "gql": "graphql", "yml": "yaml",
    "yaml": "yaml", "toml": "toml", "xml": "xml", "gradle": "groovy", "groovy": "groovy", "erb": "erb", "haml": "haml", "slim": "slim", "htm": "html", "html": "html",
    "css": "css", "scss": "css", "sass": "css", "less": "css", "json": "json", "md": "markdown", "markdown": "markdown",
}

# Directories that are never indexed.
EXCLUDED_DIRS = """node_modules dist build out .next .nuxt .svelte-kit .git .hg .svn __pycache__ .mypy_cache .ruff_cache .pytest_cache target .gradle vendor
venv Pods .dart_tool .pub-cache coverage .nyc_output tmp temp .cache logs obj CMakeFiles bower_components generated __generated__ notebook""".split()

# Words that say nothing in a name.
NAME_STOP_WORDS = """index component util helper default type interface class function const enum module export import test spec mock base abstract impl main app core
get set has is on to from with new init handler wrapper provider manager props state context config options params""".split()

# Directories without a topic, and file names that stand for their directory.
GENERIC_DIRS = "src lib app apps packages pkg source code components pages views screens features".split()
ENTRY_NAMES = "index __init__ mod page route layout loading".split()

# Words that mark a directory as tests.
TEST_WORDS = """test tests spec specs e2e mock mocks fixture fixtures stub stubs locator locators pageobject pageobjects automation cypress playwright selenium nightwatch webdriver
qa qe unittest unittests integrationtest integrationtests whiteboxtest whiteboxtests blackboxtest blackboxtests uitest uitests apitest apitests e2etest e2etests
smoketest smoketests loadtest loadtests perftest perftests""".split()

# English words without weight in prose.
PROSE_STOP_WORDS = """the and for with that this from into when where what which how why does not are was were has have had can could should would will you your
its her his they them there here about after before over under then than all any each more some such only also just being been did do get gets let lets like make makes
need needs please want use used using way now new out""".split()

# Weights and thresholds of ranked retrieval.
NAME_WEIGHT, PATH_WEIGHT, COVERAGE_WEIGHT = 3, 2, 3
RARE_FRACTION, WINDOW_LINES, PREVIEW_CLUSTERS, PREVIEW_LINES, IMPORT_BOOST = 0.05, 3, 2, 8, 1.5
LISTED, DETAILED, DOCS_LISTED, STYLES_LISTED, BRIDGES_LISTED, JSON_LISTED = 12, 3, 4, 4, 6, 40
HUB_DEGREE, MINIFIED_CHARS = 30, 1000
CALLER_FILES, CALLER_LINES, IMPORTERS, BODY_REFS, TOP_SYMBOLS, HUGE_SYMBOLS, MATCHED_SYMBOLS, LONG_FILE = 12, 3, 20, 8, 15, 20, 6, 80
SLICE_SYMBOLS, SLICE_LINES, CALLEES = 4, 450, 10
MATCH_SYMBOLS, MATCH_LINES = 4, 240
REGION_CONTEXT, REGIONS, REGION_LINES = 2, 8, 70
BM25_K1, BM25_B, CHANNELS = 1.2, 0.75, {"name": 3, "anchor": 2, "body": 1}
RESULT_FLOOR, HOOK_FLOOR, RARITY_DIVISOR, RARITY_MIN_NOTES, CONVERGE_MIN, MIN_CARRIERS, NAME_DENSITY = 0.25, 0.4, 10, 30, 4, 2, 2
PATH_MIN, PATH_BOOST, IMPLANT_RATIO = 6, 100, 1.8
ALIAS_MAX, ALIAS_WORDS, ALIAS_FLOOR = 12, 40, 4
DUPLICATE_JACCARD, BACKFILL_SYMBOLS = 0.6, 15
BARREL_RATIO, BARREL_IMPORTERS = 0.5, 1
PATCH_FLOOR, PATCH_RATIO = 30, 0.2
DEBOUNCE_MS, SAVE_SECONDS, AUDIT_SAMPLE = 400, 5, 50
TRIGGER_ARM, TRIGGER_CAP, TRIGGER_SETTLE, TRIGGER_QUIET = 10, 20, 3, 1
MAX_BYTES = 1_000_000
MIN_POSTINGS, MAX_POSTINGS = 2, 5

# Tags that wrap what a host adds to a prompt.
WRAPPER_TAGS = tuple("""system-reminder ide_opened_file ide_selection ide_diagnostics task-notification local-command-caveat local-command-stdout local-command-stderr command-name
command-message command-args user-prompt-submit-hook browser_instruction environment_context user_instructions""".split())

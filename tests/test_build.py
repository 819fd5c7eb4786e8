"""A small tree of several languages built into an index, and the API over it."""

import os

import pytest

from tessera.operators import resolve as R
from tessera.plans import api, build
from tessera.sources import extract as E
from tessera.sources import files as S

TREE = {
    "web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"], "@app/ui/*": ["ui/*"]}}}',
    "web/src/index.ts": "export { Button } from '@app/ui/button';\nexport * from './store.js';\n",
    "web/ui/button.tsx": "import { store } from '@app/store';\nexport class Button extends Base implements Widget {\n  render() {\n    return load(store);\n  }\n}\n",
    "web/src/store.ts": "export const store = 1;\nexport function load(x) {\n  return x;\n}\n",
    "web/src/main.ts": "import { Button } from '.';\nimport { load } from './store';\nexport async function boot() {\n  load(new Button());\n}\n",
    "py/app/models.py": "from .base import Base\nfrom app import util\n\nclass User(Base):\n    def save(self):\n        return util.run(self)\n",
    "py/app/base.py": "class Base:\n    pass\n",
    "py/app/util.py": "__all__ = ['run']\n\ndef run(x):\n    return x\n\ndef _hidden():\n    return run(1)\n",
    "py/app/__init__.py": "",
    "py/settings.py": "MIDDLEWARE = ['app.util.RunMiddleware']\n",
    "jvm/src/main/java/org/acme/Order.java": "package org.acme;\n\nimport org.acme.util.Money;\n\npublic class Order extends Base implements Priced {\n    public Money total(int n) { return Money.of(n); }\n    private Receipt receipt() { return null; }\n}\n",
    "jvm/src/main/java/org/acme/util/Money.java": "package org.acme.util;\npublic class Money { public static Money of(int n) { return null; } }\n",
    "jvm/src/main/java/org/acme/Receipt.java": "package org.acme;\nclass Receipt { }\n",
    "gomod/go.mod": "module example.com/shop\n\nreplace example.com/lib => ./lib\n",
    "gomod/cmd/main.go": 'package main\n\nimport (\n\t"example.com/shop/store"\n\t"example.com/lib"\n\t"fmt"\n)\n\nfunc main() {\n\tstore.Open()\n}\n',
    "gomod/store/store.go": "package store\n\ntype DB struct {\n\tName string\n}\n\nfunc Open() *DB {\n\treturn nil\n}\n\nfunc (d *DB) Close() {}\n",
    "gomod/lib/lib.go": "package lib\n\nfunc X() {}\n",
    "rs/Cargo.toml": '[workspace]\nmembers = ["core"]\n',
    "rs/core/src/lib.rs": "mod model;\nuse core::model::Thing;\n\npub fn start() {\n    helper();\n}\n\nfn helper() {}\n",
    "rs/core/src/model.rs": "pub struct Thing {\n    a: u8,\n}\n\nimpl Thing {\n    pub fn new() -> Thing { Thing { a: 1 } }\n}\n",
    "php/composer.json": '{"autoload": {"psr-4": {"App\\\\": "app/", "App\\\\Deep\\\\": "deep/"}}}',
    "php/app/Models/Post.php": "<?php\nnamespace App\\Models;\nuse App\\Models\\User;\nclass Post {\n    public function user() { return $this->belongsTo(User::class); }\n}\n",
    "php/app/Models/User.php": "<?php\nnamespace App\\Models;\nclass User { }\n",
    "rb/app/models/order.rb": "class Order < Base\n  def total\n    Cart.new\n  end\nend\n",
    "rb/app/models/cart.rb": "class Cart\n  LIMIT = 3\nend\n",
    "rb/app/controllers/orders_controller.rb": "class OrdersController\n  def show\n    Order.find(1)\n  end\nend\n",
    "rb/app/views/orders/show.html.erb": "<p>x</p>\n",
    "cs/A.cs": "namespace Shop.Core;\nusing Shop.Util;\npublic partial class Cart { public int Sum() { return 1; } }\n",
    "cs/B.cs": "namespace Shop.Core;\npublic partial class Cart { }\n",
    "cs/U.cs": "namespace Shop.Util { public class Tool { } }\n",
    "cpp/CMakeLists.txt": "include_directories(${CMAKE_CURRENT_SOURCE_DIR}/inc)\n",
    "cpp/src/b.cpp": "#include <deep/c.hpp>\n",
    "cpp/inc/deep/c.hpp": "struct C { };\n",
    "cpp/inc/a.h": "struct A { int x; };\n",
    "cpp/src/a.cpp": '#include "../inc/a.h"\n#include <vector>\nint add(int a, int b) {\n  return add(a, b);\n}\n',
    "conf/app.yaml": "server:\n  port: 1\n  host: x\ntop: 2\n",
    "conf/app.toml": "a = 1\n[s]\nb = 2\n",
    "conf/.env": "export KEY=1\nOTHER = 2 # c\nKEY=3\n",
    "conf/schema.graphql": "type Query {\n  a: Int\n}\nenum E { X }\n",
    "conf/pom.xml": '<project><artifactId>core</artifactId><bean id="b1" class="org.acme.Bean"/></project>\n',
    "conf/build.gradle": "plugins {\n  id 'java'\n}\ntask hello {\n}\nimplementation 'g:art:1'\n",
    "ui/App.vue": "<template></template>\n<script>\nexport function mounted() { return 1 }\n</script>\n",
    "node_modules/x/index.js": "module.exports = 1\n",
    "gen/a.generated.ts": "export const g = 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, tree):
    return {k: v.cache() for k, v in build.build(spark, tree).items()}


def test_walk_skips_excluded(tables):
    ids = {r.file_id for r in tables["files"].collect()}
    assert "node_modules/x/index.js" not in ids and "gen/a.generated.ts" not in ids
    assert {"web/src/index.ts", "conf/.env", "conf/build.gradle", "rb/app/views/orders/show.html.erb"} <= ids


def test_edges(tables):
    got = {(r.src, r.dst) for r in tables["edges"].collect()}
    want = {
        ("web/src/index.ts", "web/ui/button.tsx"), ("web/src/index.ts", "web/src/store.ts"), ("web/src/main.ts", "web/src/index.ts"), ("web/src/main.ts", "web/src/store.ts"), ("web/ui/button.tsx", "web/src/store.ts"),
        ("py/app/models.py", "py/app/base.py"), ("py/app/models.py", "py/app/util.py"), ("py/settings.py", "py/app/util.py"),
        ("jvm/src/main/java/org/acme/Order.java", "jvm/src/main/java/org/acme/util/Money.java"), ("jvm/src/main/java/org/acme/Order.java", "jvm/src/main/java/org/acme/Receipt.java"),
        ("gomod/cmd/main.go", "gomod/store/store.go"), ("gomod/cmd/main.go", "gomod/lib/lib.go"), ("rs/core/src/lib.rs", "rs/core/src/model.rs"),
        ("php/app/Models/Post.php", "php/app/Models/User.php"), ("rb/app/models/order.rb", "rb/app/models/cart.rb"), ("rb/app/controllers/orders_controller.rb", "rb/app/models/order.rb"),
        ("rb/app/controllers/orders_controller.rb", "rb/app/views/orders/show.html.erb"), ("cs/A.cs", "cs/U.cs"), ("cs/A.cs", "cs/B.cs"), ("cs/B.cs", "cs/A.cs"), ("cpp/src/a.cpp", "cpp/inc/a.h"), ("cpp/src/b.cpp", "cpp/inc/deep/c.hpp"),
    }
    assert want <= got, want - got
    assert not [e for e in got if e[0] == e[1]]


def test_unresolved_and_symbols(tables):
    assert "fmt" in {r.specifier for r in tables["unresolved"].collect()}
    names = {(r.file_id, r.name, r.kind) for r in tables["symbols"].collect()}
    assert {("web/ui/button.tsx", "Button", "class"), ("web/ui/button.tsx", "Button.render", "method"), ("py/app/models.py", "User.save", "method"), ("gomod/store/store.go", "DB.Close", "method"), ("rs/core/src/model.rs", "Thing.new", "method"),
            ("jvm/src/main/java/org/acme/Order.java", "Order.total", "method"), ("conf/app.yaml", "server.port", "constant"), ("conf/app.toml", "s.b", "constant"), ("conf/.env", "KEY", "constant"), ("conf/schema.graphql", "Query", "class"),
            ("conf/pom.xml", "Bean", "constant"), ("conf/build.gradle", "art", "constant"), ("ui/App.vue", "mounted", "function"), ("rb/app/models/order.rb", "Order::total", "method")} <= names


def test_symbol_edges(tables):
    e = {(r.src, r.dst, r.type) for r in tables["symbol_edges"].collect()}
    assert ("web/src/main.ts#boot", "web/src/store.ts#load", "calls") in e
    assert ("web/ui/button.tsx#Button", "Base", "extends") in e and ("web/ui/button.tsx#Button", "Widget", "implements") in e
    assert ("py/app/util.py", "py/app/util.py#run", "exports") in e and ("py/app/util.py", "py/app/util.py#_hidden", "exports") not in e


def test_snapshot(spark, tables, tmp_path):
    d = str(tmp_path / "snap")
    for n in (1, 2, 3):
        assert S.save_snapshot({"edges": tables["edges"]}, d, "h") == n
    assert sorted(x for x in os.listdir(d) if x.startswith("gen")) == ["gen=2", "gen=3"]
    assert S.load_snapshot(spark, d)["edges"].count() == tables["edges"].count()
    assert S.update_head(d, "h2") and S.read_meta(d)["head"] == "h2"
    with pytest.raises(ValueError):
        S.save_snapshot({}, d, expected=("edges",))
    (tmp_path / "snap" / "_meta.json").write_text("{")
    assert S.load_snapshot(spark, d) is None


def test_two_writers(spark, tables, tmp_path):
    """Writers that start from one generation take different numbers; the later marker stays; all of it by URI."""
    d = "file://" + str(tmp_path / "snap")
    assert S.save_snapshot({"edges": tables["edges"]}, d, "h1") == 1
    assert S.Store(spark, d).create("", "gen=2", "_claim")  # another writer is at work on the second generation
    assert S.save_snapshot({"edges": tables["edges"]}, d, "h3") == 3 and S.read_meta(d)["head"] == "h3"
    S.Store(spark, d).replace('{"gen": 9, "version": "1", "tables": []}', "_meta.json")
    assert S.save_snapshot({"edges": tables["edges"]}, d, "h10") == 10 and S.update_head(d, "x") and S.read_meta(d) | {"saved_at": 0} == {"version": "1", "gen": 10, "head": "x", "tables": ["edges"], "saved_at": 0}
    assert S.read_meta(d + "none") is None and not S.update_head(d + "none", "x")


def test_exclusive_append(spark, tmp_path):
    d = "file://" + str(tmp_path / "log")
    rec = lambda *ids: spark.createDataFrame([(i, "{}") for i in ids], "note_id string, record string")
    S.append_records(rec("a", "b"), d, "h", exclusive=True)
    S.append_records(rec("a"), d)
    with pytest.raises(ValueError):
        S.append_records(rec("c", "a"), d, exclusive=True)
    assert S.Store(spark, d).create("", "_claims", "d") and not S.Store(spark, d).create("", "_claims", "d")
    with pytest.raises(ValueError):
        S.append_records(rec("d"), d, exclusive=True)  # claimed by another writer
    S.append_records(rec("c"), d, exclusive=True)
    assert sorted(r.note_id for r in spark.read.parquet(d).collect()) == ["a", "a", "b", "c"]


def test_probe(tables):
    p = build.probe(tables)
    stats = {r.language: r.ratio for r in p["stats"].collect()}
    assert stats["typescript"] == 1.0 and 0 < stats["go"] < 1


def test_log(spark, tmp_path):
    (tmp_path / "n1.jsonl").write_text('{"v":1}\n\nnot json\n{"v":2}\n')
    good, bad = S.read_log(spark, str(tmp_path))
    assert good.count() == 2 and [r.line for r in bad.collect()] == ["not json"]
    assert [r.note_id for r in S.list_ids(spark, str(tmp_path)).collect()] == ["n1"]


def test_extract_never_fails(spark):
    for lang in [*E.EXTRACTORS, "html", None]:
        for text in (None, "", "{{{ ((( \" ' ` <", "\x00", "x" * 5000):
            r = E.extract_text(text, lang)
            assert set(r) == set(E.empty())
    E.register(spark)
    assert spark.sql("SELECT name FROM extract('def f(): pass', 'python')").first()[0] == "f"
    assert spark.sql("SELECT fold_sep('a-b_c'), squash('A/b.c'), token_estimate('abcde')").first()[:] == ("abc", "abc", 2)


def test_normalize(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a/../b/./c",), ("../x",), ("",), ("a//b/",)], "p string").select(R.normalize(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["b/c", "x", "", "a/b"]


def test_api_checks():
    assert api.check_spec([]) and api.check_spec({"op": "x"}) and api.check_spec({"type": "flow", "character": "hub"}) and api.check_spec({"type": "file", "facets": []}) and api.check_spec({"type": "flow", "id": "BAD ID"})
    assert api.check_spec({"type": "file-hub", "path": "a"}) is None
    assert api.missing_fields({"type": "flow"}) == ["identityAliases", "steps"]


def test_aliases_of_configurations(spark):
    rows = [
        ("m/tsconfig.base.json", '{"compilerOptions": {"baseUrl": "./lib", "paths": {"@far/*": ["far/*"], "@both": ["base"]}}}'),
        ("m/app/tsconfig.json", '{// child\n"extends": ["../tsconfig.base", "../none"], "compilerOptions": {"paths": {"@both": ["own", "own2"], "@url": ["x//y"],}}}'),
        ("m/loop/tsconfig.json", '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"@l": ["l"]}}}'), ("m/bad/tsconfig.json", "{"), ("m/null/tsconfig.json", None),
        ("m/package.json", '{"name": "root", "workspaces": {"packages": ["packages/*", "!packages/no", "tools"]}}'), ("m/packages/a/package.json", '{"name": "@s/a"}'), ("m/packages/deep/b/package.json", '{"name": "b"}'), ("m/tools/package.json", '{"name": "tools"}'),
        ("p/pnpm-workspace.yaml", "packages:\n  - 'x-*/lib'\n  - '!q'\n"), ("p/x-1/lib/package.json", '{"name": "one"}'), ("p/q/package.json", '{"name": "q"}'),
        ("r/Cargo.toml", '[workspace]\nmembers = ["crates/*", "cli"]\n'), ("r/crates/k-v/Cargo.toml", '[package]\nname = "k-v"\n'), ("r/cli/Cargo.toml", '[package]\nname = "cli"\n'),
    ]
    scopes = S.configs(spark.createDataFrame(rows, "file_id string, text string"))
    got = {(r.scope, r.prefix, r.target, r.ord) for r in scopes["aliases"].collect()}
    assert got == {
        ("m/app", "@far", "/m/lib/far", 0), ("m/app", "@both", "/m/lib/own", 0), ("m/app", "@both", "/m/lib/own2", 1), ("m/app", "@url", "/m/lib/x//y", 0), ("m/loop", "@l", "/m/loop/l", 0),
        ("m", "@s/a", "/m/packages/a", 1), ("m", "tools", "/m/tools", 1), ("p", "one", "/p/x-1/lib", 1),
    }
    crates = {(r.scope, r.name, r.src) for r in scopes["crates"].collect()}
    assert {("r", "k_v", "r/crates/k-v/src"), ("r", "cli", "r/cli/src")} <= crates
    files = spark.createDataFrame([(f, None) for f in ("m/app/a.ts", "m/lib/own2.ts", "m/lib/far/z/index.ts", "m/packages/a/src/util.ts", "m/packages/a/index.js", "m/lib/x/y.ts")], "file_id string, package_name string")
    imports = spark.createDataFrame([("m/app/a.ts", s) for s in ("@both", "@far/z", "@s/a", "@s/a/src/util", "@url", "@s/none", "react")], "file_id string, specifier string")
    hit = {r.specifier: r.target for r in R.resolve_alias(imports, files, scopes["aliases"]).collect()}
    assert hit == {"@both": "m/lib/own2.ts", "@far/z": "m/lib/far/z/index.ts", "@s/a": "m/packages/a/index.js", "@s/a/src/util": "m/packages/a/src/util.ts", "@url": "m/lib/x/y.ts", "@s/none": None, "react": None}


def test_probing_order(spark):
    """The first extension, then index files; a JavaScript path finds itself first, then its TypeScript source; 90 directories are walked from the near end."""
    deep = "/".join(["r"] + [f"d{i}" for i in range(90)])
    ids = ["r/a.js", "r/a.ts", "r/b/index.js", "r/b/mod.rs", "r/c.tsx", "r/d.d.ts", "r/e.mts", "r/v1.2/x.py", f"{deep}/near.py", "r/d0/near.py", f"{deep}/src/only.py", "r/p/__init__.py"]
    files = spark.createDataFrame([(i, None) for i in ids] + [(None, None)], "file_id string, package_name string")
    rel = [("r/m.ts", s) for s in ("./a", "./a.js", "./b", "./c.js", "./c.jsx", "./d", "./e.mjs", "./none", "../../../r/a", "./v1.2/x")] + [(None, "./a")]
    got = {r.specifier: r.target for r in R.resolve_relative(spark.createDataFrame(rel, "file_id string, specifier string"), files).where("file_id is not null").collect()}
    assert got == {"./a": "r/a.ts", "./a.js": "r/a.js", "./b": "r/b/index.js", "./c.js": "r/c.tsx", "./c.jsx": "r/c.tsx", "./d": "r/d.d.ts", "./e.mjs": "r/e.mts", "./none": None, "../../../r/a": "r/a.ts", "./v1.2/x": "r/v1.2/x.py"}
    py = spark.createDataFrame([(f"{deep}/m.py", s) for s in ("near", "only", "p", "." * 91 + "p", "gone")], "file_id string, specifier string")
    got = {r.specifier: r.target for r in R.resolve_python(py, files).collect()}
    assert got == {"near": f"{deep}/near.py", "only": f"{deep}/src/only.py", "p": "r/p/__init__.py", "." * 91 + "p": "r/p/__init__.py", "gone": None}

"""A small tree in several languages, and by hand what the parsers have to find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "Cargo.toml": '[package]\nname = "demo"\n\n[dependencies]\n# none = "0"\nserde-json = "1.0"\ntokio = { version = "1", features = ["full"] }\n\n[dev-dependencies]\nquick_check = "1"\n',
    "web/package.json": '{\n  "name": "demo",\n  "dependencies": {\n    "@acme/widgets": "^1.0",\n    "lodash": "4"\n  },\n  "devDependencies": {\n    "jest": "29"\n  },\n  "license": "MIT"\n}\n',
    "go.mod": "module demo\n\nrequire (\n\tgithub.com/acme/tool v1.2.3\n)\nrequire golang.org/x/text v0.1.0\n",
    "requirements.txt": "# pinned\nnumpy>=1.0\nmy-lib[extra]==2\n-r other.txt\n\nflask\n",
    "pyproject.toml": '[project]\nname = "demo"\n\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = ">=0.2"\n\n[build-system]\nrequires = ["x"]\n',
    "Gemfile": "source 'https://example.org'\ngem 'rails', '~> 7.0'\ngem \"puma\"\n",
    "src/store.py": "from app.core import base\nimport os\n\n\nclass Store:\n    def load(self, path):\n        return parse(read(path))\n\n    def save(self, path):\n        os.write(path)\n\n\ndef parse(raw):\n    return raw.strip()\n",
    "src/main.py": "from src.store import Store\n\n\ndef main():\n    s = Store()\n    s.load('x')\n    parse('y')\n",
    "src/lib.rs": "use std::fs;\n\npub struct Tree {\n    depth: u32,\n}\n\nimpl Tree {\n    pub fn grow(&self) -> u32 {\n        measure(self.depth)\n    }\n}\n\nfn measure(d: u32) -> u32 {\n    d + 1 // not_a_call(x)\n}\n",
    "web/index.ts": "import { get } from './net';\n\nfunction show(id) {\n  return render(get(id));\n}\n\nclass View {\n  draw(x) {\n    show(x);\n  }\n}\n",
    "cmd/main.go": 'package main\n\nimport "fmt"\n\nfunc main() {\n\tfmt.Println(sum(1, 2))\n}\n\nfunc sum(a, b int) int {\n\treturn a + b\n}\n',
    "lib/Main.java": "public class Main {\n  public static void main(String[] args) {\n    run(args);\n  }\n  static void run(String[] a) {\n    System.out.println(a);\n  }\n}\n",
    "native/add.c": "struct point { int x; };\n\nint add(int a, int b) {\n  return twice(a) + b;\n}\n",
    "app/user.rb": "module App\n  class User\n    def greet(name)\n      puts(name) if name\n    end\n  end\nend\n",
    "notes.csv": "a,b\n1,2\n",
    "data/config.yaml": "a: 1\n",
}

SYMBOLS = [
    ("src/store.py", "class", "Store", 5, 10),
    ("src/store.py", "function", "load", 6, 7),
    ("src/store.py", "function", "save", 9, 10),
    ("src/store.py", "function", "parse", 13, 14),
    ("src/main.py", "function", "main", 4, 7),
    ("src/lib.rs", "struct", "Tree", 3, 5),
    ("src/lib.rs", "impl", "Tree", 7, 11),
    ("src/lib.rs", "function", "grow", 8, 10),
    ("src/lib.rs", "function", "measure", 13, 15),
    ("web/index.ts", "function", "show", 3, 5),
    ("web/index.ts", "class", "View", 7, 11),
    ("web/index.ts", "method", "draw", 8, 10),
    ("cmd/main.go", "function", "main", 5, 7),
    ("cmd/main.go", "function", "sum", 9, 11),
    ("lib/Main.java", "class", "Main", 1, 8),
    ("lib/Main.java", "method", "main", 2, 4),
    ("lib/Main.java", "method", "run", 5, 7),
    ("native/add.c", "struct", "point", 1, 1),
    ("native/add.c", "function", "add", 3, 5),
    ("app/user.rb", "module", "App", 1, 7),
    ("app/user.rb", "class", "User", 2, 6),
    ("app/user.rb", "method", "greet", 3, 5),
]
CALLS = [
    ("src/store.py", "parse"),
    ("src/store.py", "read"),
    ("src/store.py", "write"),
    ("src/store.py", "strip"),
    ("src/main.py", "Store"),
    ("src/main.py", "load"),
    ("src/main.py", "parse"),
    ("src/lib.rs", "measure"),
    ("web/index.ts", "render"),
    ("web/index.ts", "get"),
    ("web/index.ts", "show"),
    ("cmd/main.go", "Println"),
    ("cmd/main.go", "sum"),
    ("lib/Main.java", "run"),
    ("lib/Main.java", "println"),
    ("native/add.c", "twice"),
    ("app/user.rb", "puts"),
]
IMPORTS = [("src/store.py", "app/core.py"), ("src/main.py", "src/store.py"), ("src/lib.rs", "use std::fs;"), ("web/index.ts", "./net"), ("cmd/main.go", "fmt")]
EDGES = [
    ("src/store.py", "load", "src/store.py", "parse"),
    ("src/main.py", "main", "src/store.py", "Store"),
    ("src/main.py", "main", "src/store.py", "load"),
    ("src/main.py", "main", "src/store.py", "parse"),
    ("src/lib.rs", "grow", "src/lib.rs", "measure"),
    ("web/index.ts", "draw", "web/index.ts", "show"),
    ("cmd/main.go", "main", "cmd/main.go", "sum"),
    ("lib/Main.java", "main", "lib/Main.java", "run"),
]
DEPENDENCIES = [
    ("Cargo.toml", "serde-json"),
    ("Cargo.toml", "serde_json"),
    ("Cargo.toml", "tokio"),
    ("Cargo.toml", "quick_check"),
    ("Cargo.toml", "quick-check"),
    ("web/package.json", "@acme/widgets"),
    ("web/package.json", "widgets"),
    ("web/package.json", "lodash"),
    ("web/package.json", "jest"),
    ("go.mod", "github.com/acme/tool"),
    ("go.mod", "tool"),
    ("go.mod", "golang.org/x/text"),
    ("go.mod", "text"),
    ("requirements.txt", "numpy"),
    ("requirements.txt", "my-lib"),
    ("requirements.txt", "my_lib"),
    ("requirements.txt", "flask"),
    ("pyproject.toml", "python"),
    ("pyproject.toml", "httpx"),
    ("Gemfile", "rails"),
    ("Gemfile", "puma"),
]
IMPORTED = [
    ("src/store.py", "app.core"),
    ("src/store.py", "base"),
    ("src/store.py", "os"),
    ("src/main.py", "src.store"),
    ("src/main.py", "Store"),
    ("src/lib.rs", "std"),
    ("web/index.ts", "get"),
    ("web/index.ts", "net"),
    ("web/index.ts", "./net"),
    ("cmd/main.go", "fmt"),
    # a line that begins and ends with a quote counts as quoted
    ("web/package.json", 'lodash": "4'),
    ("web/package.json", 'jest": "29'),
    ("web/package.json", 'license": "MIT'),
]
LANGUAGES = [("toml", 2), ("json", 1), ("mod", 1), ("txt", 1), ("other", 1), ("python", 2), ("rust", 1), ("typescript", 1), ("go", 1), ("java", 1), ("c", 1), ("ruby", 1), ("csv", 1), ("yaml", 1)]
ENTRY_POINTS = [("src/main.py",), ("web/index.ts",), ("cmd/main.go",), ("lib/Main.java",)]
MODEL_DEPENDENCIES = [("Python",), ("Rust",), ("TypeScript",), ("Go",), ("Java",), ("C",)]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(sorted(FILES.items()))], "doc_id long, path string, text string")


def values_sql(name: str, columns: str) -> str:
    """The expected rows of that name as SQL."""
    said = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in globals()[name])}) v({columns})"

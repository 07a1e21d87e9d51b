"""A small tree in six languages and what scanning and linking it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language, module_id

SOURCES = {
    "shop/__init__.py": '"""Shop."""\n',
    "shop/price.py": (
        "import os\n\nRATES = {}\n\n\ndef rate(item, qty=1):\n    \"\"\"Rate of an item.\n\n    More text.\n    \"\"\"\n    return RATES.get(item) * qty\n\n\n"
        "def reduced(item):\n    # half\n    return rate(item) / 2\n"
    ),
    "shop/basket.py": (
        "from shop import price\nfrom .price import rate, reduced\n\n\nclass Basket:\n    '''\n    Holds items.\n    '''\n\n    def __init__(self):\n        self.items = []\n\n"
        "    async def add(self, item):\n        self.items.append(item)\n\n        def inner(x):\n            return x\n\n    def total(self):\n        if not self.items:\n            return 0\n"
        "        return sum(rate(i) for i in self.items)\n\n\ndef make():\n    return Basket()\n"
    ),
    "main.py": "from shop.basket import make\n\n\ndef run():\n    basket = make()\n    print(basket.total())\n\n\nrun()\n",
    "web/ui.ts": (
        "import { show, hide as gone } from './dom'\nimport './side'\n\nexport interface Item {\n  id: number\n}\nexport type Key = string\n\nexport class Panel {\n"
        "  constructor(private item: Item) {\n    this.open()\n  }\n  open(): void { show(this.item) } // method\n  if (x) {\n  }\n}\n\nexport const render = (p: Panel) => p.open()\nexport function boot(root) {\n  return new Panel(root)\n}\n"
    ),
    "web/dom.js": "const { pick, drop } = require('./pick')\nconst fs = require('fs')\nfunction show(x) {\n  pick(x)\n  while (x) { drop(x) }\n}\n",
    "web/pick.js": "export function pick(x) { return x }\n",
    "srv/run.go": (
        'package srv\n\nimport "fmt"\n\nimport (\n\t"fmt"\n\t"strings"\n)\n\ntype Store struct {\n}\n\ntype Finder interface {\n}\n\nfunc (s *Store) Find(k string) string {\n\treturn strings.ToUpper(k)\n}\n\n'
        "func Serve(k string) {\n\tfmt.Println(trim(k))\n}\n"
    ),
    "srv/trim.go": "package srv\n\nfunc trim(k string) string {\n\treturn k\n}\n",
    "App.java": (
        "package com.app;\n\nimport java.util.List;\nimport static com.app.Sum.add;\n\npublic class App {\n    public static void main(String[] args) {\n        Sum.add(1, 2);\n        return helper(args);\n    }\n\n"
        "    private Map<String, Integer> helper(String[] a) throws Error {\n        System.out.println(a);\n    }\n}\n"
    ),
    "Sum.java": "package com.app;\n\npublic class Sum {\n    static int add(int a, int b) {\n        return a + b;\n    }\n}\n",
    "geo/lib.rs": (
        "use std::fmt;\n\npub struct Point {\n    x: f64,\n}\n\npub trait Shape {\n    fn area(&self) -> f64 {\n        0.0\n    }\n}\n\nimpl Point {\n    pub fn origin() -> Point {\n        dist(0.0)\n    }\n}\n\npub fn dist(a: f64) -> f64 {\n    a.sqrt()\n}\n"
    ),
    "geo/main.rs": "mod lib;\n\nfn main() {\n    let p = lib::Point::origin();\n    println!(\"{}\", lib::dist(1.0));\n}\n",
}

# (path, kind, name, qualname, parent, start_line, end_line, signature, doc)
SYMBOLS = [
    ("shop/price.py", "function", "rate", "shop.price.rate", "", 6, 13, "item, qty=1", "Rate of an item."),
    ("shop/price.py", "function", "reduced", "shop.price.reduced", "", 14, 16, "item", ""),
    ("shop/basket.py", "class", "Basket", "shop.basket.Basket", "", 5, 24, "", "Holds items."),
    ("shop/basket.py", "method", "__init__", "shop.basket.Basket.__init__", "shop.basket.Basket", 10, 12, "self", ""),
    ("shop/basket.py", "method", "add", "shop.basket.Basket.add", "shop.basket.Basket", 13, 18, "self, item", ""),
    ("shop/basket.py", "function", "inner", "shop.basket.Basket.add.inner", "shop.basket.Basket.add", 16, 18, "x", ""),
    ("shop/basket.py", "method", "total", "shop.basket.Basket.total", "shop.basket.Basket", 19, 24, "self", ""),
    ("shop/basket.py", "function", "make", "shop.basket.make", "", 25, 26, "", ""),
    ("main.py", "function", "run", "main.run", "", 4, 8, "", ""),
    ("web/ui.ts", "interface", "Item", "web/ui.Item", "", 4, 6, "", ""),
    ("web/ui.ts", "type", "Key", "web/ui.Key", "", 7, 8, "", ""),
    ("web/ui.ts", "class", "Panel", "web/ui.Panel", "", 9, 17, "", ""),
    ("web/ui.ts", "method", "constructor", "web/ui.Panel.constructor", "web/ui.Panel", 10, 12, "private item: Item", ""),
    ("web/ui.ts", "method", "open", "web/ui.Panel.open", "web/ui.Panel", 13, 17, "", ""),
    ("web/ui.ts", "function", "render", "web/ui.render", "", 18, 18, "p: Panel", ""),
    ("web/ui.ts", "function", "boot", "web/ui.boot", "", 19, 21, "root", ""),
    ("web/dom.js", "function", "show", "web/dom.show", "", 3, 6, "x", ""),
    ("web/pick.js", "function", "pick", "web/pick.pick", "", 1, 1, "x", ""),
    ("srv/run.go", "type", "Store", "srv.Store", "", 10, 12, "", ""),
    ("srv/run.go", "interface", "Finder", "srv.Finder", "", 13, 15, "", ""),
    ("srv/run.go", "method", "Find", "srv.Store.Find", "srv.Store", 16, 19, "k string", ""),
    ("srv/run.go", "function", "Serve", "srv.Serve", "", 20, 22, "k string", ""),
    ("srv/trim.go", "function", "trim", "srv.trim", "", 3, 5, "k string", ""),
    ("App.java", "class", "App", "com.app.App", "", 6, 15, "", ""),
    ("App.java", "method", "main", "com.app.App.main", "com.app.App", 7, 11, "String[] args", ""),
    ("App.java", "method", "helper", "com.app.App.helper", "com.app.App", 12, 15, "String[] a", ""),
    ("Sum.java", "class", "Sum", "com.app.Sum", "", 3, 7, "", ""),
    ("Sum.java", "method", "add", "com.app.Sum.add", "com.app.Sum", 4, 7, "int a, int b", ""),
    ("geo/lib.rs", "type", "Point", "geo/lib.Point", "", 3, 6, "", ""),
    ("geo/lib.rs", "interface", "Shape", "geo/lib.Shape", "", 7, 18, "", ""),
    ("geo/lib.rs", "method", "area", "geo/lib.Shape.area", "geo/lib.Shape", 8, 13, "&self", ""),
    ("geo/lib.rs", "method", "origin", "geo/lib.Point.origin", "geo/lib.Point", 14, 18, "", ""),
    ("geo/lib.rs", "function", "dist", "geo/lib.dist", "", 19, 21, "a: f64", ""),
    ("geo/main.rs", "function", "main", "geo/main.main", "", 3, 6, "", ""),
]

# (path, line, caller_name, callee, qualname of the symbol it resolves to or None)
CALLS = [
    ("shop/price.py", 11, "shop.price.rate", "RATES.get", None),
    ("shop/price.py", 16, "shop.price.reduced", "rate", "shop.price.rate"),
    ("shop/basket.py", 14, "shop.basket.Basket.add", "self.items.append", None),
    ("shop/basket.py", 22, "shop.basket.Basket.total", "sum", None),
    ("shop/basket.py", 22, "shop.basket.Basket.total", "rate", "shop.price.rate"),
    ("shop/basket.py", 26, "shop.basket.make", "Basket", "shop.basket.Basket"),
    ("main.py", 5, "main.run", "make", "shop.basket.make"),
    ("main.py", 6, "main.run", "print", None),
    ("main.py", 6, "main.run", "basket.total", "shop.basket.Basket.total"),
    ("main.py", 9, "", "run", "main.run"),
    ("web/ui.ts", 11, "web/ui.Panel.constructor", "this.open", "web/ui.Panel.open"),
    ("web/ui.ts", 13, "web/ui.Panel.open", "show", "web/dom.show"),
    ("web/ui.ts", 18, "web/ui.render", "p.open", "web/ui.Panel.open"),
    ("web/ui.ts", 20, "web/ui.boot", "Panel", "web/ui.Panel"),
    ("web/dom.js", 4, "web/dom.show", "pick", "web/pick.pick"),
    ("web/dom.js", 5, "web/dom.show", "drop", None),
    ("srv/run.go", 17, "srv.Store.Find", "strings.ToUpper", None),
    ("srv/run.go", 21, "srv.Serve", "fmt.Println", None),
    ("srv/run.go", 21, "srv.Serve", "trim", "srv.trim"),
    ("App.java", 8, "com.app.App.main", "Sum.add", "com.app.Sum.add"),
    ("App.java", 9, "com.app.App.main", "helper", "com.app.App.helper"),
    ("App.java", 13, "com.app.App.helper", "System.out.println", None),
    ("geo/lib.rs", 15, "geo/lib.Point.origin", "dist", "geo/lib.dist"),
    ("geo/lib.rs", 20, "geo/lib.dist", "a.sqrt", None),
    ("geo/main.rs", 4, "geo/main.main", "lib::Point::origin", "geo/lib.Point.origin"),
    ("geo/main.rs", 5, "geo/main.main", "lib::dist", "geo/lib.dist"),
]

# (path, module, names, kind, line, path it resolves to or None)
IMPORTS = [
    ("shop/price.py", "os", "", "module", 1, None),
    ("shop/basket.py", "shop", "price", "from", 1, "shop/__init__.py"),
    ("shop/basket.py", ".price", "rate,reduced", "from", 2, "shop/price.py"),
    ("main.py", "shop.basket", "make", "from", 1, "shop/basket.py"),
    ("web/ui.ts", "./dom", "show,hide,gone", "import", 1, "web/dom.js"),
    ("web/ui.ts", "./side", "", "import", 2, None),
    ("web/dom.js", "./pick", "pick,drop", "require", 1, "web/pick.js"),
    ("web/dom.js", "fs", "fs", "require", 2, None),
    ("srv/run.go", "fmt", "", "module", 3, None),
    ("srv/run.go", "strings", "", "module", 6, None),
    ("App.java", "java.util.List", "", "import", 3, None),
    ("App.java", "com.app.Sum.add", "", "import", 4, None),
    ("geo/lib.rs", "std::fmt", "", "use", 1, None),
    ("geo/main.rs", "lib", "", "mod", 1, "geo/lib.rs"),
]


def files(spark: SparkSession) -> DataFrame:
    """(path, lang, module, text) of the tree."""
    rows = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    rows = rows.withColumn("lang", language(F.col("path")))
    return rows.select("path", "lang", module_id(F.col("path"), F.col("lang"), F.col("text")).alias("module"), "text")

"""What the chunkers know about languages."""

from __future__ import annotations

# Node kinds of each grammar as ``type: kind``, ``*`` marks a type that
# gives its name to what it encloses; a node without a kind is split only.
GRAMMARS: dict[tuple[str, ...], dict[str, str]] = {
    ("javascript", "js"): {"function_declaration": "function", "arrow_function": "function", "export_statement": "function", "method_definition": "method", "class_declaration": "class*"},
    ("typescript", "ts"): {"function_declaration": "function", "arrow_function": "function", "export_statement": "function", "method_definition": "method", "class_declaration": "class*", "interface_declaration": "interface*", "type_alias_declaration": "typedef"},
    ("python", "py"): {"function_definition": "function", "async_function_definition": "function", "decorated_definition": "function", "class_definition": "class*"},
    ("java",): {"method_declaration": "method", "constructor_declaration": "method", "class_declaration": "class*", "interface_declaration": "interface*"},
    ("cpp", "c++", "c"): {"function_definition": "function", "declaration": "function", "class_specifier": "class*", "namespace_definition": "class*"},
    ("go",): {"function_declaration": "function", "method_declaration": "method", "type_declaration": "typedef", "var_declaration": "typedef", "const_declaration": "typedef"},
    ("rust", "rs"): {"function_item": "function", "impl_item": "class*", "struct_item": "class*", "enum_item": "enum*", "trait_item": "interface*", "mod_item": "class*"},
    ("csharp", "cs"): {"method_declaration": "method", "class_declaration": "class*", "interface_declaration": "interface*", "struct_declaration": "class*", "enum_declaration": "enum*"},
    ("scala",): {"method_declaration": "method", "constructor_declaration": "method", "class_declaration": "class*", "interface_declaration": "interface*"},
    ("haxe", "hx"): {"ClassType": "class*", "EnumType": "enum*", "AbstractType": "abstract*", "DefType": "typedef*", "ClassMethod": "method"},
    ("hxml",): {"section": ""},
    ("ocaml", "ml"): {"value_definition": "function", "external": "function", "method_definition": "method", "type_definition": "typedef", "exception_definition": "typedef", "module_definition": "class*", "class_definition": "class*", "module_type_definition": "interface*", "class_type_definition": "interface*"},
    ("ocaml_interface", "mli"): {"value_specification": "function", "external": "function", "type_definition": "typedef", "exception_definition": "typedef", "module_definition": "class*", "class_definition": "class*", "module_type_definition": "interface*", "class_type_definition": "interface*"},
}

# Languages whose files are cut along their syntax.
SYNTAX_LANGUAGES = ("javascript", "js", "typescript", "ts", "python", "py", "java", "cpp", "c++", "c", "go", "rust", "rs", "cs", "csharp", "scala", "haxe", "hx", "hxml")

# Names that the recursive chunker knows, and what they stand for.
RECURSIVE_NAMES = {
    "javascript": "js", "typescript": "js", "python": "python", "java": "java", "cpp": "cpp", "c++": "cpp", "c": "cpp", "go": "go", "rust": "rust", "php": "php",
    "ruby": "ruby", "swift": "swift", "scala": "scala", "html": "html", "markdown": "markdown", "md": "markdown", "latex": "latex", "tex": "latex", "solidity": "sol", "sol": "sol",
}

#: Keywords at the start of a line that the recursive chunker prefers to cut before.
STARTS = {
    "js": ["function", "const", "let", "var", "class", "if", "for", "while", "switch", "case", "default"],
    "python": ["class", "def", "\tdef"],
    "java": ["class", "public", "protected", "private", "static", "if", "for", "while", "switch", "case"],
    "cpp": ["class", "void", "int", "float", "double", "if", "for", "while", "switch", "case"],
    "go": ["func", "var", "const", "type", "if", "for", "switch", "case"],
    "rust": ["fn", "const", "let", "if", "while", "for", "loop", "match"],
    "php": ["function", "class", "if", "foreach", "while", "do", "switch", "case"],
    "ruby": ["def", "class", "if", "unless", "while", "for", "do", "begin", "rescue"],
    "swift": ["func", "class", "struct", "enum", "if", "for", "while", "do", "switch", "case"],
    "scala": ["class", "object", "def", "val", "var", "if", "for", "while", "match", "case"],
    "markdown": ["#", "##", "###", "####", "#####", "######", "```", "***", "---", "___"],
    "html": ["<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span", "<table", "<tr", "<td", "<th", "<ul", "<ol", "<header", "<footer", "<nav"],
    "latex": ["\\chapter{", "\\section{", "\\subsection{", "\\subsubsection{", "\\begin{"],
    "sol": ["pragma", "using", "contract", "interface", "library", "constructor", "type", "function", "event", "modifier", "error", "struct", "enum", "if", "for", "while"],
}


def node_kinds() -> list[tuple[str, str, str, bool]]:
    """``(language, node type, kind, gives its name)`` of every grammar."""
    return [(lang, node, kind.rstrip("*"), kind.endswith("*")) for langs, nodes in GRAMMARS.items() for lang in langs for node, kind in nodes.items()]

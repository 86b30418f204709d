"""Names that rows share: roles, languages, kinds of statements, relations, actions and tiers. Fixed values."""

from __future__ import annotations

LANGUAGES = {
    "py": "Python", "ts": "TypeScript", "tsx": "TSX", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JSX", "mjs": "JavaScript", "cjs": "JavaScript",
    "md": "Markdown", "json": "JSON", "toml": "TOML", "yaml": "YAML", "yml": "YAML", "cfg": "INI", "ini": "INI",
    "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "swift": "Swift", "rb": "Ruby", "php": "PHP", "cs": "C#", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "scala": "Scala",
}
ANALYSED = ("Python", "TypeScript", "TSX", "JavaScript", "JSX")
FAMILIES = {"Python": "python", "TypeScript": "ecmascript", "TSX": "ecmascript", "JavaScript": "ecmascript", "JSX": "ecmascript"}

TEST_PARTS = ("__tests__", "integration-test", "integration-tests", "integration_test", "integration_tests", "test", "tests", "testing")
FIXTURE_PARTS = ("fixture", "fixtures", "golden", "snapshots")
GENERATED_PARTS = ("generated", "gen")
VENDOR_PARTS = ("vendor", "third_party", "third-party", "node_modules", ".yarn")
BUILD_PARTS = ("dist", ".next", ".nuxt")
DOCUMENT_SUFFIXES = ("md", "rst", "txt")
CONFIG_SUFFIXES = ("cfg", "ini", "json", "toml", "yaml", "yml")
CONFIG_NAMES = (".gitignore", ".pre-commit-config.yaml", "package.json", "pyproject.toml", "pytest.ini", "setup.cfg")
MANIFESTS = {"python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt", "Pipfile"), "node": ("package.json", "tsconfig*.json", "jsconfig.json")}
TEST_ROLES = ("test", "fixture")

RELATIONS = (
    "none", "body_identical", "body_parameterized", "argument_normalization_wrapper", "same_skeleton_different_literals", "same_skeleton_different_callees",
    "common_prefix_divergent_tail", "common_suffix_divergent_setup", "common_wrapper_different_core", "same_core_different_wrapper",
    "same_argument_flow_different_control", "same_call_set_different_order", "same_statements_different_order",
)
CLONE_OF_RELATION = {
    "none": ("signature_signal_only", "boundary_only"),
    "body_identical": ("type_2_parameterized", "same_name_normalized_body"),
    "body_parameterized": ("type_2_parameterized", "parameterized_normalized_body"),
    "same_skeleton_different_literals": ("type_2_parameterized", "parameterized_normalized_body"),
    "argument_normalization_wrapper": ("type_3_near_miss", "typed_argument_normalization_wrapper"),
    "same_skeleton_different_callees": ("type_3_near_miss", "same_skeleton_different_callees"),
    "common_prefix_divergent_tail": ("type_3_near_miss", "common_prefix_divergent_tail"),
    "common_suffix_divergent_setup": ("type_3_near_miss", "common_suffix_divergent_setup"),
    "common_wrapper_different_core": ("type_3_near_miss", "common_wrapper_different_core"),
    "same_core_different_wrapper": ("type_3_near_miss", "same_core_different_wrapper"),
    "same_argument_flow_different_control": ("contract_analogy", "contract_analogy"),
    "same_statements_different_order": ("type_3_near_miss", "same_statements_different_order"),
    "same_call_set_different_order": ("contract_analogy", "contract_analogy"),
}
DELTA_RISK = {
    "OPERATOR_DELTA": 0.50, "RETURN_VALUE_DELTA": 0.18, "ERROR_HANDLING_DELTA": 0.18, "CONTROL_FLOW_DELTA": 0.15, "LOOP_DELTA": 0.14, "ARGUMENT_FLOW_DELTA": 0.12, "CALLEE_NAME_DELTA": 0.10,
    "RECEIVER_SHAPE_DELTA": 0.10, "EXTRA_CONTEXT_MANAGER_DELTA": 0.10, "DEFAULT_ARGUMENT_DELTA": 0.06, "LITERAL_VALUE_DELTA": 0.04, "EXTRA_LOCAL_TEMPORARY_DELTA": 0.04,
    "EXTRA_ASSIGNMENT_DELTA": 0.04, "EXTRA_TERMINAL_CALL_DELTA": 0.08, "ARGUMENT_NORMALIZATION_DELTA": 0.06,
}
RELATEDNESS = {"parameter": 0.20, "call": 0.15, "sequence": 0.15, "tree": 0.20, "graph": 0.15, "name": 0.05}

INTERFACE_ROLES = ("typing_overload", "overload_signature", "abstract_or_interface_stub", "declaration_boundary")
PROTOCOL_ROLES = ("operator_overload", "descriptor_method", "attribute_access_hook", "container_protocol", "comparison_protocol", "context_manager_protocol", "async_protocol", "property_accessor")
API_ROLES = (
    "adapter_forwarder", "public_api_mirror", "sync_async_mirror", "command_or_registry_surface", "implementation_contract_method", "framework_connector",
    "framework_render_surface", "framework_hook", "generated_or_cython_boundary",
)
TIERS = ("recommended_edit", "review_candidate", "maintenance_note", "observation")

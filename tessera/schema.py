"""Table schemas, closed vocabularies and the error type."""

from __future__ import annotations

# Names of entity and relation kinds, reasons and issue types.
ENTITY_TYPES = ("java_class", "java_method", "backend_api", "frontend_api_call", "python_class", "python_function")
RELATION_TYPES = ("CONTAINS", "DEFINES_API", "REQUESTS_API", "CALLS_METHOD")
CHAIN_TYPES = ("REQUESTS_API", "DEFINES_API", "CALLS_METHOD")
SKIP_REASONS = ("SYMLINK_FILE", "FILE_TOO_LARGE", "READ_ERROR", "BINARY_FILE", "DECODE_ERROR")

FILES = "project_id long, file_path string, language string, line_count int, file_hash string, size_bytes long, content string"
ISSUES = "project_id long, file_path string, issue_type string, reason_code string, message string"
ENTITY = "local_key string, entity_type string, name string, qualified_name string, file_path string, start_line int, end_line int, content string, metadata_json string"
RELATION = "source_key string, target_key string, relation_type string, confidence double, metadata_json string"
REQUEST = "file_path string, start_line int, end_line int, start_byte int, content string, callee string, url_expression string, method_expression string"
ENTITIES = f"project_id long, id long, {ENTITY}"
RELATIONS = "project_id long, id long, source_id long, target_id long, relation_type string, confidence double, metadata_json string"
CONVERSATIONS = "id long, project_id long, title string, created_at timestamp, updated_at timestamp"
MESSAGES = "id long, conversation_id long, role string, content string, task_type string, metadata_json string, created_at timestamp"
PROJECTS = "id long, name string, root_path string, status string, sort_order int, last_scan_at timestamp, created_at timestamp, updated_at timestamp"


class DomainError(Exception):
    """An error with a code and an HTTP status, raised on the driver only."""

    def __init__(self, code: str, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.code, self.message, self.status = code, message, status

"""Rule lists for classification.

Fixed values: words, order, labels, scores and texts below must equal what portfolio
users see today. A rule list is ``[(label, words), ...]``; order decides ties.
"""

# C14: business domain of a chunk, by words in its name and content
CHUNK_DOMAINS = [
    ("authentication", "auth login logout signin signup password token jwt session user credential verify authenticate "
                       "authorize oauth sso ldap saml bearer basic_auth"),
    ("database", "db database sql query select insert update delete table schema model orm migration connection pool "
                 "transaction commit rollback index foreign_key primary_key"),
    ("api", "api rest graphql endpoint route controller handler request response http get post put patch delete "
            "middleware cors rate_limit swagger openapi json xml"),
    ("business_logic", "business logic rule workflow process service domain entity aggregate repository factory strategy "
                       "command event handler validator calculator processor manager"),
    ("ui", "ui component view template render display form button input modal dialog menu navigation layout style css "
           "html dom event click hover focus"),
    ("integration", "integration external third_party webhook notification email sms push queue message event publish "
                    "subscribe kafka rabbitmq redis cache cdn aws azure"),
    ("security", "security encrypt decrypt hash ssl tls certificate key secret sanitize validate xss csrf injection "
                 "firewall permission role acl audit log monitor"),
    ("testing", "test spec mock stub fixture assert expect should unit integration e2e scenario given when then setup "
                "teardown before after describe it jest pytest"),
    ("configuration", "config setting option parameter property environment env variable constant default initialize "
                      "setup bootstrap start init load parse validate schema"),
    ("monitoring", "monitor metric log trace debug error warn info alert notification dashboard report analytics "
                   "performance benchmark profiler health status ping heartbeat"),
]

# Business domain of a repository, by words in its name
REPOSITORY_DOMAINS = [
    ("authentication", "auth login oauth jwt session"),
    ("billing", "payment billing invoice subscription"),
    ("user_management", "user profile account management"),
    ("notification", "notification email sms push"),
    ("analytics", "analytics metrics tracking events"),
    ("api", "api rest graphql endpoint"),
    ("database", "database db sql migration"),
    ("frontend", "frontend ui web react vue angular"),
    ("backend", "backend server service api"),
    ("infrastructure", "infrastructure deploy config docker"),
    ("security", "security encryption ssl firewall"),
    ("monitoring", "monitoring logging metrics alerts"),
]

# First match wins; matched in lower case unless the name says otherwise
TABLE_DOMAIN = [  # upper case
    ("account", ["ACCOUNT", "ACCT"]), ("customer", ["CUSTOMER", "CUST"]), ("contract", ["CONTRACT", "CNTRCT"]),
    ("policy", ["POLICY", "PLCY"]), ("claim", ["CLAIM", "CLM"]), ("payment", ["PAYMENT", "PMT"]),
    ("transaction", ["TRANSACTION", "TXN"]), ("lookup", ["LOOKUP", "LU_", "CODE"]), ("reference_data", ["REF"]),
    ("audit_log", ["LOG", "AUDIT", "HISTORY"]),
]
RULE_DOMAIN = [
    ("security", ["user", "login", "auth", "permission"]), ("financial", ["amount", "payment", "contract", "policy"]),
    ("customer_management", ["customer", "client", "account"]), ("validation", ["validate", "required", "empty"]),
]
JSP_PURPOSE = [
    ("user_interface_form", ["struts_tags"]), ("dynamic_content_generation", ["scriptlets"]),
    ("user_session_handling", ["session_management"]), ("data_access_layer", ["direct_db_access"]),
]
SQL_CONTEXT_PATH = [
    ("account_management", ["account"]), ("customer_management", ["customer"]), ("contract_policy", ["contract", "policy"]),
    ("payment_billing", ["payment", "billing"]), ("claims_processing", ["claim"]),
]
SQL_CONTEXT_TEXT = [
    ("business_data_access", ["account", "customer", "contract", "policy"]),
    ("reference_data_access", ["lookup", "code", "reference"]),
]
DEPENDENCY_FRAMEWORK = [
    ("struts", ["struts", "org.apache.struts"]), ("corba", ["corba", "omg.org", "jacorb", "org.omg"]),
    ("jsp", ["jsp", "jstl", "servlet", "javax.servlet"]), ("spring", ["springframework", "spring-"]),
    ("hibernate", ["hibernate", "org.hibernate"]), ("apache", ["apache", "org.apache"]),
    ("logging", ["log4j", "slf4j", "logback", "commons-logging"]),
    ("testing", ["junit", "testng", "mockito", "easymock"]), ("utility", ["commons-", "guava", "jackson"]),
]
LEGACY_FRAMEWORKS = ["struts", "corba", "jsp"]
ACTION_DOMAIN = [
    ("Customer Management", ["customer", "user", "account"]), ("Order Management", ["order", "purchase", "billing"]),
    ("Inventory Management", ["inventory", "product", "catalog"]), ("Reporting", ["report", "analytics", "dashboard"]),
]
TABLE_CONTEXT = [  # upper case
    ("account_management", ["ACCOUNT", "ACCT"]), ("contract_management", ["CONTRACT", "CNTRCT"]),
    ("customer_management", ["CUSTOMER", "CUST"]), ("policy_management", ["POLICY", "PLCY"]),
    ("reference_data", ["LOOKUP", "CODE", "REF"]),
]
COLUMN_PURPOSE = [  # upper case; a word that starts with $ must end the name
    ("Monetary amount field", ["AMOUNT"]), ("Classification/category field", ["TYPE"]), ("Status indicator field", ["STATUS"]),
    ("Date/time field", ["DATE"]), ("Identifier/reference field", ["$_ID", "$_NO"]), ("Name/description field", ["NAME"]),
]
CATALOG_COLUMN_PURPOSE = [  # upper case
    ("Financial amount field", ["AMOUNT"]), ("Classification/category field", ["TYPE"]), ("Status indicator field", ["STATUS"]),
    ("Date/timestamp field", ["DATE"]), ("Identifier field", ["$ID"]),
]
ENDPOINT_TYPE = [("Admin Interface", ["admin", "manage"]), ("User Interface", ["user", "profile", "account"])]
FILE_TYPE = [
    ("Java Class", ["$.java"]), ("JSP Page", ["$.jsp"]), ("Configuration", ["$.xml"]), ("Properties", ["$.properties"]),
]
LEGACY_FILE_KIND = [
    ("java_files", ["$.java"]), ("config_files", ["$.xml", "$.properties", "$.yml", "$.yaml"]),
    ("jsp_files", ["$.jsp", "$.tag", "$.tagx"]),
]
STRUTS_TAG_PURPOSE = {
    "html:form": "User input form", "html:text": "Text input field", "html:select": "Selection/dropdown",
    "html:submit": "Form submission", "bean:write": "Data display", "logic:iterate": "List/collection display",
    "logic:present": "Conditional display", "logic:notPresent": "Conditional display",
}
VISUAL_LABELS = ["Repository", "Directory", "File", "Class", "Function", "MavenArtifact", "Endpoint", "Database"]
GRAPHQL_TYPE = {
    "Int": ["long", "int", "integer", "short", "byte"], "Float": ["double", "float", "decimal", "bigdecimal"],
    "Boolean": ["bool", "boolean"], "ID": ["id", "uuid"],
}
SECURITY_ADVICE = [
    ("Implement JWT or OAuth2 for stateless authentication", ["authentication"]),
    ("Use role-based access control (RBAC) in GraphQL", ["authorization"]),
    ("Implement input validation at GraphQL resolver level", ["validation"]),
    ("Use structured error handling with GraphQL error extensions", ["error"]),
    ("Consider stateless token-based session management", ["session"]),
]
SECURITY_ADVICE_DEFAULT = "Review and adapt security pattern for modern architecture"
QUESTION_CONTEXT = [
    ("universal life", ["universal", "ul", "life insurance"]), ("account", ["account", "acct"]),
    ("contract", ["contract", "policy"]), ("customer", ["customer", "client"]), ("payment", ["payment", "billing"]),
    ("claim", ["claim", "claims"]),
]

# C17: base score per chunk type, 0.5 for any other
CHUNK_TYPE_SCORES = {
    "class_definition": 1.0, "function_definition": 0.8, "method_definition": 0.6, "variable": 0.3, "import": 0.2,
}
# Decision words, counted as substrings
DECISION_WORDS = "if elif else while for try except finally with switch case".split()
# Decision words, counted as whole words
REGEX_DECISION_WORDS = "if while for try catch switch".split()
# Flags and the words that raise them
CONTENT_FLAGS = {
    "has_error_handling": ["try", "catch", "except"], "has_loops": ["for", "while", "loop"],
    "has_conditionals": ["if", "switch", "case"], "has_async": ["async", "await", "promise"],
    "has_database": ["query", "select", "insert", "update", "delete"],
    "has_api_calls": ["request", "response", "http", "api"],
}
# Words that start a block, per language; Python's serve any other language
BLOCK_WORDS = {
    "python": "if elif else try except finally with for while def class".split(),
    "javascript": "if else try catch finally for while function class".split(),
    "java": "if else try catch finally for while switch case".split(),
}
# B1: directory patterns **/x/** that mean "any path segment x"
EXCLUDED_DIRECTORIES = (
    "node_modules target build dist .git bin obj .vscode .idea __pycache__ .pytest_cache coverage htmlcov logs tmp temp"
).split()
# B2: suffix to language, in order
LANGUAGE_SUFFIXES = [
    (".py", "python"), (".js", "javascript"), (".jsx", "javascript"), (".ts", "typescript"), (".tsx", "typescript"),
    (".rs", "rust"), (".go", "go"), (".java", "java"), (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"), (".c", "cpp"),
    (".h", "cpp"), (".hpp", "cpp"), (".cs", "c_sharp"), (".rb", "ruby"), (".php", "php"), (".kt", "kotlin"),
    (".swift", "swift"), (".jsp", "jsp"), (".tag", "jsp"), (".tagx", "jsp"), (".xml", "xml"), (".idl", "xml"),
]
# B2: else by tokens: all of the first, and any of the second
LANGUAGE_TOKENS = [
    ("python", ["def ", "import "], []), ("javascript", ["function "], ["var ", "let ", "const "]),
    ("rust", ["fn ", "use "], []), ("go", ["func ", "package "], []), ("java", ["public class ", "import "], []),
]
# Suspicious request patterns
SUSPICIOUS = [
    r"(?i)(union|select|insert|update|delete|drop|create|alter)\s+", r"(?i)<script[^>]*>.*?</script>", r"(?i)javascript:",
    r"(?i)on\w+\s*=", r"\.\./", r"%2e%2e%2f", r"(?i)(exec|eval|system|cmd)",
]
# Migration notes for scriptlets
JSP_NOTES = [
    (["session.getAttribute"], "Session usage -> Angular state management (NgRx/services)"),
    (["request.getParameter"], "Request parameters -> Angular reactive forms"),
    (["Connection", "PreparedStatement", "ResultSet"], "Direct DB access -> GraphQL resolver with proper data layer"),
    (["out.println"], "Dynamic content generation -> Angular templating"),
]

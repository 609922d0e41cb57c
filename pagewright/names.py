"""Names that stand in outputs."""

#: What the classes of formatted HTML begin with; set it before other modules are imported to use another.
CLASS_PREFIX = "page-"
#: What a line of a progress log begins with.
PROGRESS_MARKER = "__PROGRESS__ "

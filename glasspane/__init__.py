"""Link, page-content and corpus analytics as Spark jobs."""

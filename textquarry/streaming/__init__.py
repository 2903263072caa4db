"""The search operators on unbounded inputs."""

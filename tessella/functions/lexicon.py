"""Tables of terms for query expansion, and the bank of evaluation queries."""

from __future__ import annotations

#: Terms that stand for a phrase, in order.
SYNONYMS = {
    "peak load": ["high traffic", "traffic spike", "load surge", "heavy concurrency"],
    "high traffic": ["peak load", "traffic spike", "load surge", "flash crowd"],
    "autoscaling": ["auto scaling", "horizontal scaling", "elastic scaling", "dynamic provisioning"],
    "scaling": ["autoscaling", "horizontal scaling", "vertical scaling", "elasticity"],
    "latency": ["response time", "processing delay", "round-trip time", "end-to-end delay"],
    "failure": ["fault", "outage", "downtime", "crash", "service disruption"],
    "fault": ["failure", "error", "crash", "node failure"],
    "cache": ["in-memory store", "Redis", "buffer", "memory cache"],
    "caching": ["in-memory caching", "Redis caching", "cache-aside", "write-through cache"],
    "load balancing": ["traffic distribution", "request routing", "round-robin", "least connections"],
    "rate limiting": ["throttling", "quota enforcement", "API rate control", "request throttling"],
    "distributed": ["multi-node", "clustered", "sharded", "replicated", "federated"],
    "monitoring": ["observability", "metrics collection", "distributed tracing", "alerting"],
    "kubernetes": ["k8s", "container orchestration", "pod management", "HPA", "cluster management"],
    "microservices": ["service mesh", "distributed services", "API gateway", "service decomposition"],
    "database": ["data store", "persistence layer", "storage backend", "RDBMS"],
    "concurrency": ["parallelism", "multi-threading", "async processing", "parallel execution"],
    "fault tolerance": ["resilience", "high availability", "disaster recovery", "failover"],
    "throughput": ["requests per second", "RPS", "TPS", "capacity", "bandwidth"],
    "replication": ["data replication", "replica sync", "primary-replica", "synchronous replication"],
    "consensus": ["raft protocol", "paxos", "leader election", "quorum", "distributed agreement"],
    "partition": ["sharding", "data partitioning", "hash partitioning", "range partitioning"],
    "circuit breaker": ["resilience pattern", "fault isolation", "hystrix", "open circuit state"],
    "retry": ["retry policy", "exponential backoff", "jitter", "retry mechanism"],
    "service discovery": ["consul", "etcd", "DNS discovery", "health check registry"],
    "observability": ["monitoring", "distributed tracing", "metrics dashboard", "OpenTelemetry"],
    "container": ["docker container", "pod", "container image", "OCI image"],
    "deployment": ["rollout", "release", "blue-green deployment", "canary release", "rolling update"],
    "api gateway": ["ingress controller", "reverse proxy", "rate limiting gateway", "routing layer"],
    "message queue": ["kafka", "pub/sub", "rabbitmq", "async messaging", "event streaming"],
    "traffic spike": ["peak load", "burst traffic", "sudden load increase", "flash crowd"],
    "node failure": ["server crash", "instance termination", "hardware failure", "pod eviction"],
    "consistency": ["strong consistency", "eventual consistency", "linearizability", "CAP theorem"],
    "horizontal scaling": ["scale out", "add instances", "autoscaling", "replica count increase"],
    "availability": ["uptime", "SLA", "high availability", "99.99%", "fault tolerance"],
    "security": ["authentication", "authorisation", "TLS encryption", "RBAC", "zero trust"],
    "cdn": ["content delivery network", "edge cache", "PoP", "static asset caching"],
}
#: Terms of a domain, by the beginning of a word, in order.
DOMAIN_TERMS = {
    "scal": ["autoscaling", "load balancing", "horizontal scaling", "Kubernetes HPA", "traffic management"],
    "load": ["CPU utilisation", "memory pressure", "request queue", "throughput", "traffic distribution"],
    "fail": ["circuit breaker", "retry policy", "fallback strategy", "bulkhead pattern", "fault tolerance"],
    "cache": ["TTL expiration", "cache invalidation", "eviction policy", "Redis", "cache hit rate"],
    "data": ["replication", "sharding", "consistency model", "durability", "ACID transactions"],
    "network": ["TCP connection", "TLS handshake", "CDN", "load balancer", "network latency"],
    "deploy": ["blue-green deployment", "canary release", "rolling update", "rollback", "health check"],
    "monitor": ["Prometheus metrics", "Grafana dashboard", "alerting rules", "SLO", "error budget"],
    "securit": ["authentication", "RBAC", "TLS encryption", "audit logging", "zero trust network"],
    "queue": ["Kafka", "Pub/Sub", "consumer group", "dead letter queue", "backpressure"],
    "distrib": ["consensus protocol", "leader election", "quorum", "replication lag", "CAP theorem"],
    "concur": ["thread pool", "async I/O", "event loop", "lock contention", "race condition"],
    "latenc": ["p99 latency", "response time", "network RTT", "connection pooling", "timeout policy"],
    "throughp": ["RPS", "TPS", "burst capacity", "rate limiting", "connection pooling"],
    "kubernetes": ["pod scheduling", "Horizontal Pod Autoscaler", "node affinity", "resource limits"],
}
#: Terms for a query that matches nothing.
GENERIC_TERMS = ["scalability", "performance", "reliability", "system design"]
#: Evaluation queries: query, keywords that make a passage relevant, category.
QUERY_BANK = [
    ("How does the system handle peak load?", ["autoscaling", "horizontal scaling", "load balancing", "traffic spike", "scale out", "peak load", "concurrent"], "scalability"),
    ("What happens when a node fails?", ["fault tolerance", "failover", "replication", "high availability", "circuit breaker", "node failure", "crash"], "fault_tolerance"),
    ("How is traffic distributed across servers?", ["load balancing", "round-robin", "weighted", "least connections", "traffic distribution", "request routing"], "load_balancing"),
    ("How do we prevent API abuse?", ["rate limiting", "throttling", "quota", "token bucket", "leaky bucket", "sliding window"], "rate_limiting"),
    ("How is data stored consistently across multiple nodes?", ["replication", "consistency", "consensus", "raft", "paxos", "eventual consistency", "strong consistency", "quorum"], "data_consistency"),
    ("How does Kubernetes scale applications automatically?", ["HPA", "horizontal pod autoscaler", "autoscaling", "replicas", "kubernetes", "pod", "scale"], "kubernetes"),
    ("How do we reduce database query response time?", ["cache", "caching", "redis", "in-memory", "query optimization", "index", "connection pool"], "performance"),
    ("How are microservices discovered at runtime?", ["service discovery", "consul", "etcd", "dns", "registry", "service mesh", "kubernetes"], "microservices"),
    ("What patterns prevent cascading failures?", ["circuit breaker", "bulkhead", "retry", "timeout", "fallback", "resilience", "fault isolation"], "resilience"),
    ("How is system health monitored in production?", ["monitoring", "observability", "metrics", "prometheus", "grafana", "alerting", "tracing", "logging"], "observability"),
]

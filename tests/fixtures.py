"""Small documents of our own that exercise filters, extractors and reads."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

T0 = datetime(2024, 5, 1, 12, 0)

SERVICE = {"apiVersion": "v1", "kind": "Service", "metadata": {"name": "web", "namespace": "shop", "uid": "svc-1"}, "spec": {"type": "LoadBalancer", "clusterIP": "10.0.0.5"}, "status": {"loadBalancer": {}}}
NODE = {"apiVersion": "v1", "kind": "Node", "metadata": {"name": "n1", "uid": "node-1", "labels": {"node.kubernetes.io/instance-type": "m5"}}, "status": {"capacity": {"cpu": "4", "memory": "16380048Ki", "pods": "110"}, "allocatable": {"cpu": "3920m"}, "conditions": [{"type": "Ready", "status": "False"}, {"type": "MemoryPressure", "status": "True", "lastHeartbeatTime": "x"}]}}
POD_READY = {"apiVersion": "v1", "kind": "Pod", "metadata": {"name": "web-0", "namespace": "shop", "uid": "pod-1", "resourceVersion": "1", "ownerReferences": [{"apiVersion": "apps/v1", "kind": "ReplicaSet", "name": "web-rs"}]}, "spec": {"nodeName": "n1", "serviceAccountName": "sa", "volumes": [{"secret": {"secretName": "cred"}}, {"persistentVolumeClaim": {"claimName": "disk"}}], "containers": [{"name": "c", "image": "img", "resources": {"requests": {"cpu": "500m", "memory": "1Gi"}}, "envFrom": [{"configMapRef": {"name": "conf"}}]}]}, "status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}], "containerStatuses": [{"name": "c", "restartCount": 0}]}}
POD_DOWN = json.loads(json.dumps(POD_READY)) | {"status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "False"}], "containerStatuses": [{"name": "c", "restartCount": 2, "state": {"waiting": {"reason": "CrashLoopBackOff"}}, "lastState": {"terminated": {"reason": "OOMKilled"}}}]}}
SLICE = {"apiVersion": "discovery.k8s.io/v1", "kind": "EndpointSlice", "metadata": {"name": "web-abc", "namespace": "shop", "uid": "slice-1", "labels": {"kubernetes.io/service-name": "web"}}, "endpoints": [{"targetRef": {"kind": "Pod", "name": "web-0"}, "conditions": {"ready": False}}]}
EVENT = {"apiVersion": "v1", "kind": "Event", "metadata": {"name": "e1", "namespace": "shop", "uid": "ev-1"}, "involvedObject": {"kind": "Pod", "name": "web-0", "namespace": "shop"}, "reason": "BackOff", "type": "Warning", "message": "Back-off restarting", "count": 4, "source": {"component": "kubelet"}}
SECRET = {"apiVersion": "v1", "kind": "Secret", "metadata": {"name": "cred", "namespace": "shop", "uid": "sec-1"}, "data": {"a": "eA=="}}
BINDING = {"apiVersion": "rbac.authorization.k8s.io/v1", "kind": "RoleBinding", "metadata": {"name": "rb", "namespace": "shop", "uid": "rb-1"}, "roleRef": {"kind": "ClusterRole", "name": "admin"}, "subjects": [{"kind": "ServiceAccount", "name": "sa"}, {"kind": "User", "name": "ann"}]}
WEBHOOK = {"apiVersion": "admissionregistration.k8s.io/v1", "kind": "ValidatingWebhookConfiguration", "metadata": {"name": "wh", "uid": "wh-1"}, "webhooks": [{"name": "v.x", "failurePolicy": "Fail", "clientConfig": {"service": {"name": "hook", "namespace": "sys"}}}]}

INCIDENT = [(SERVICE, 0), (NODE, 1), (POD_READY, 2), (POD_DOWN, 10), (SLICE, 11), (EVENT, 12), (SECRET, 13), (BINDING, 14), (WEBHOOK, 15)]


def decoded(spark, items=INCIDENT, kinds=None):
    rows = [("c1", T0 + timedelta(minutes=m), (kinds or {}).get(i, "MODIFIED"), json.dumps(d)) for i, (d, m) in enumerate(items)]
    return spark.createDataFrame(rows, "cluster_id string, observed_at timestamp, observation_type string, doc string")
